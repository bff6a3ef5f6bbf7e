"""Short-answer benchmark replies: grading, summary, validation; and the curated index rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import estimate_tokens

# --- fixed values ---------------------------------------------------------------------------
NUMBER = r"-?[0-9]+(?:\.[0-9]+)?"
RESULT_SCHEMA = "bench.v1"
TASKS = [
    ("arith-add", "42", "number"), ("arith-sub", "63", "number"), ("arith-mul", "42", "number"), ("arith-div", "9", "number"),
    ("arith-sq", "144", "number"), ("count-week", "7", "number"), ("count-hours", "24", "number"), ("count-min", "60", "number"),
    ("conv-km", "3000", "number"), ("conv-dozen", "24", "number"), ("cmp-max", "84", "number"), ("cmp-min", "3", "number"),
    ("cap-fr", "paris", "word"), ("cap-jp", "tokyo", "word"), ("cap-it", "rome", "word"), ("cap-eg", "cairo", "word"),
    ("chem-au", "au", "word"), ("chem-o", "o", "word"), ("planet-big", "jupiter", "word"), ("day-next", "tuesday", "word"),
    ("month-first", "january", "word"), ("opp-hot", "cold", "word"), ("opp-up", "down", "word"), ("plural-mouse", "mice", "word"),
    ("color-mix", "green", "word"), ("yesno-gt", "yes", "word"), ("yesno-even", "no", "word"), ("es-hello", "hola", "word"),
    ("ko-cap", "서울", "word"), ("ko-add", "5", "number"),
]
INDEX_COLUMNS = ["id", "entity", "metric", "value", "unit", "period_start", "period_end", "grade", "source_url", "source_title", "accessed",
                 "curator", "verifier", "notes"]
INDEX_REQUIRED = [c for c in INDEX_COLUMNS if c not in ("verifier", "notes")]
INDEX_METRICS = ["capex_ai", "capex_total", "revenue_ai", "circular_deal", "depreciation_life_years", "power_contracted_mw", "power_operational_mw", "utilization_pct"]
INDEX_GRADES = ["reported", "estimated", "measured"]
# ---------------------------------------------------------------------------------------------


def correct(reply: str | Column, answer: str | Column, kind: str | Column) -> Column:
    """One of the first three numbers; or the answer as a whole word (inside the text for CJK)."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    reply, answer, kind = c(reply), c(answer), c(kind)
    t = F.lower(F.trim(F.regexp_replace(F.coalesce(reply, F.lit("")), "[*_`\"'“”‘’]", "")))
    numbers = F.slice(F.regexp_extract_all(F.regexp_replace(t, ",", ""), F.lit(NUMBER), F.lit(0)), 1, 3)
    words = F.concat(F.lit(" "), F.regexp_replace(t, r"(?U)\W+", " "), F.lit(" "))
    word = F.when(answer.rlike(r"^\p{ASCII}*\z"), words.contains(F.concat(F.lit(" "), answer, F.lit(" ")))).otherwise(t.contains(answer))
    return F.when(kind == "number", F.array_contains(numbers, answer)).otherwise(word)


def task_table(spark) -> DataFrame:
    return spark.createDataFrame(TASKS, "id string, answer string, kind string")


def grade(replies: DataFrame, tasks: DataFrame) -> DataFrame:
    """replies: (model, settings, id, reply, completion_tokens nullable, reasoning_tokens nullable)."""
    r = replies.join(F.broadcast(tasks), "id")  # thirty tasks
    return r.withColumns({
        "correct": correct("reply", "answer", "kind"), "measured": F.col("completion_tokens").isNotNull(),
        "completion_tokens": F.coalesce("completion_tokens", estimate_tokens("reply")), "reasoning_tokens": F.coalesce("reasoning_tokens", F.lit(0)),
        "min_tokens": F.greatest(F.lit(1), estimate_tokens("answer"))})


def summarize(graded: DataFrame, by: list[str] = ("model", "settings")) -> DataFrame:
    ok = F.col("correct")
    s = graded.groupBy(*by).agg(
        F.count(F.lit(1)).alias("tasks"), F.count(F.when(ok, 1)).alias("n_correct"), F.sum(F.when(ok, F.col("completion_tokens"))).alias("spent"),
        F.sum(F.when(ok, F.col("min_tokens"))).alias("minimal"), F.sum(F.when(ok, F.col("reasoning_tokens"))).alias("reasoning"), F.count(F.when(F.col("measured"), 1)).alias("n_measured"))
    return s.select(*by, "tasks", (F.col("n_correct") / F.col("tasks")).alias("accuracy"), F.try_divide("spent", "n_correct").alias("completion_tokens_per_correct"),
                    (1 - F.try_divide("minimal", "spent")).alias("overcompute_ratio"), F.try_divide("reasoning", "spent").alias("reasoning_share"), (F.col("n_measured") / F.col("tasks")).alias("measured_share"))


def result_errors(rows: DataFrame, tasks: DataFrame, claimed: DataFrame | None = None) -> DataFrame:
    """(result, error). rows: (result, id, correct, completion_tokens, reasoning_tokens, min_tokens, measured).
    Coverage both ways, non-negative counts, and the claimed summary against the recomputed one."""
    n = rows.groupBy("result", "id").agg(F.count(F.lit(1)).alias("n"))
    many = n.where("n > 1").select("result")
    extra = rows.select("result", "id").join(F.broadcast(tasks.select("id")), "id", "left_anti").select("result")
    want = tasks.count()  # thirty tasks
    short = n.join(F.broadcast(tasks.select("id")), "id").groupBy("result").agg(F.count(F.lit(1)).alias("have")).where(F.col("have") < want).select("result")
    cover = many.unionByName(extra).unionByName(short).distinct().withColumn("error", F.lit("rows do not cover exactly the task set"))
    bad = rows.where(~F.coalesce(F.col("completion_tokens") >= 0, F.lit(False))).select("result", F.concat("id", F.lit(": bad completion_tokens")).alias("error"))
    errors = cover.unionByName(bad)
    if claimed is not None:
        names = ["accuracy", "completion_tokens_per_correct", "overcompute_ratio", "reasoning_share", "measured_share"]
        digits = {"completion_tokens_per_correct": 1}
        s = summarize(rows, ["result"])
        j = s.join(claimed.select("result", *[F.col(c).alias(f"_{c}") for c in names]), "result").join(errors.select("result").distinct(), "result", "left_anti")
        same = F.lit(True)
        for c in names:
            same = same & F.round(c, digits.get(c, 3)).eqNullSafe(F.col(f"_{c}"))
        errors = errors.unionByName(j.where(~same).select("result", F.lit("summary does not match rows").alias("error")))
    return errors


def settings_key(model: Column, settings: Column, taskset: str) -> Column:
    """File key of a result: slug of the model and a digest of its settings."""
    slug = F.substring(F.regexp_replace(F.regexp_replace(F.lower(model), "[^a-z0-9.]+", "-"), r"^-+|-+\z", ""), 1, 80)
    return F.concat(slug, F.lit("__"), F.substring(F.sha2(F.concat_ws("|", model, settings), 256), 1, 8), F.lit(f"__{taskset}"))


def duplicate_results(results: DataFrame) -> DataFrame:
    """results: (result, key). Every result but the first of its key."""
    first = results.groupBy("key").agg(F.min("result").alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return results.join(first, "key").where("result <> kept").select("result", F.concat(F.lit("duplicate of "), "kept").alias("error"))


# ---------------------------------------------------------------- curated index


def index_errors(rows: DataFrame, require_verified: bool = True) -> DataFrame:
    """(line, error). rows: the 14 text columns and a line number."""
    c = lambda n: F.coalesce(F.col(n), F.lit(""))
    has = lambda n: c(n) != ""
    iso = lambda n: c(n).rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z") & F.try_to_date(c(n), "yyyy-MM-dd").isNotNull()
    seen = rows.where(has("id")).groupBy("id").agg(F.min("line").alias("_first"))
    r = rows.join(seen, "id", "left")
    when = lambda bad, msg: F.when(bad, msg if isinstance(msg, Column) else F.lit(msg))
    rules = [when(F.trim(c(n)) == "", f"missing {n}") for n in INDEX_REQUIRED]
    rules += [
        when(has("id") & ~c("id").rlike(r"^[a-z0-9][a-z0-9-]{2,80}\z"), "id must be lowercase slug"),
        when(has("id") & (F.col("line") > F.col("_first")), F.concat(F.lit("duplicate id "), c("id"))),
        when(has("metric") & ~c("metric").isin(INDEX_METRICS), F.concat(F.lit("unknown metric "), c("metric"))),
        when(has("grade") & ~c("grade").isin(INDEX_GRADES), "grade must be one of estimated, measured, reported"),
        when(F.expr("try_cast(value as double)").isNull(), "value must be numeric"),
        *[when(has(n) & ~iso(n), f"{n} must be YYYY-MM-DD") for n in ("period_start", "period_end", "accessed")],
        when(has("source_url") & ~c("source_url").startswith("https://"), "source_url must be https"),
        when((F.trim(c("verifier")) == "") & F.lit(require_verified), "unverified (a second person must fill 'verifier')"),
        when((F.trim(c("verifier")) != "") & (F.trim(c("verifier")) == F.trim(c("curator"))), "verifier must differ from curator")]
    return r.select("line", F.explode(F.array_compact(F.array(*rules))).alias("error"))


def index_value(utilisation: Column, overcompute: Column, avoidable: Column) -> Column:
    """E = U (1 - M) (1 - W), all as fractions."""
    return utilisation * (1 - overcompute) * (1 - avoidable)


def capital_ratio(rows: DataFrame) -> DataFrame:
    """K: attributed revenue per unit of attributed investment, by period."""
    v = F.expr("try_cast(value as double)")
    return rows.groupBy("period_start").agg(F.sum(F.when(F.col("metric") == "revenue_ai", v)).alias("revenue"), F.sum(F.when(F.col("metric") == "capex_ai", v)).alias("capex")) \
        .withColumn("k", F.try_divide("revenue", "capex"))
