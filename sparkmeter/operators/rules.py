"""Rule-tier flags per instruction: discarded output (W4), stale context (W5), over-exploration (W8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import scale
from ..functions.intent import is_read_command
from ..functions.text import distinctive_terms, estimate_tokens

# --- fixed values: thresholds of the rule tier ------------------------------------------------
EXPLORE = ["Read", "Grep", "Glob", "WebFetch", "WebSearch", "LS", "NotebookRead"]
W8_MIN_SHARED = 2
W5_MIN_SHARE = 0.10
W8_MIN_TOKENS = 1_000
W8_MIN_SHARE = 0.50
W4_MIN_TOKENS = 200
# ------------------------------------------------------------------------------------------------
LINE_ORDER = ["at", "rank", "pos", "bpos"]


def discarded_output(writes: DataFrame, order: list[str] = LINE_ORDER) -> DataFrame:
    """writes: (session_id, path, instr, tokens) whole-file writes. W4: versions later replaced whole."""
    w = scale.scan(writes, ["session_id", "path"], order, _next=scale.following(F.lit(1)))
    return w.where("_next IS NOT NULL AND instr >= 1 AND tokens >= 1").groupBy("session_id", "instr").agg(F.sum("tokens").alias("w4"))


def whole_file_writes(uses: DataFrame) -> DataFrame:
    return uses.where("name = 'Write' AND path IS NOT NULL").withColumn("tokens", estimate_tokens("body"))


def stale_context(parts: DataFrame, calls: DataFrame, order: list[str] = ("k",)) -> DataFrame:
    """Carried-and-dead tokens per instruction that carries them. Two rows per segment and a running
    sum stand for the interval; nothing is expanded."""
    dead = parts.where("lo < end")
    steps = dead.select("session_id", F.inline(F.array(
        F.struct(F.col("lo").alias("k"), F.col("tokens").alias("d")), F.struct(F.col("end").alias("k"), (-F.col("tokens")).alias("d")))))
    steps = steps.groupBy("session_id", "k").agg(F.sum("d").alias("d"))
    c = calls.join(steps, ["session_id", "k"], "left")
    c = scale.scan(c, ["session_id"], list(order), stale=scale.running_sum(F.coalesce("d", F.lit(0.0))))
    return c.where("instr >= 1").groupBy("session_id", "instr").agg(F.sum("stale").alias("w5"), F.sum("context").alias("w5_input"))


def term_reach(out_terms: DataFrame) -> DataFrame:
    """(session_id, ctx_key, term, last_k): last output of each context that holds a non-common term."""
    t = out_terms.groupBy("session_id", "ctx_key", "term").agg(F.count(F.lit(1)).alias("df"), F.max("k").alias("last_k"))
    active = out_terms.groupBy("session_id", "ctx_key").agg(F.count_distinct("k").alias("active"))
    return t.join(active, ["session_id", "ctx_key"]).where(F.col("df") <= F.greatest(F.lit(3.0), 0.02 * F.col("active"))) \
        .select("session_id", "ctx_key", "term", "last_k")


def exploration(uses: DataFrame) -> DataFrame:
    """Successful results of read-type tools and read-only shell commands."""
    explores = F.col("name").isin(EXPLORE) | ((F.col("name") == "Bash") & is_read_command("command"))
    u = uses.where(explores & F.col("has_result") & ~F.col("is_error"))
    u = u.withColumns({"tokens": estimate_tokens("result_text"), "terms": distinctive_terms("result_text")})
    return u.select("session_id", "use_id", "ctx_key", "instr", "tokens", "terms",
                    F.col("result_ctx_at").alias("ctx_at"), F.col("result_at").alias("main_at")).where("instr >= 1 AND tokens > 0")


def over_exploration(explored: DataFrame, out_terms: DataFrame) -> DataFrame:
    """W8 per instruction: exploration results of which fewer than two non-common terms appear in a
    later output of the same context (or of the main session, for a sub-agent)."""
    reach = term_reach(out_terms)
    one = explored.select("session_id", "use_id", "ctx_key", "ctx_at", "main_at", F.explode("terms").alias("term"))
    own = one.join(reach, ["session_id", "ctx_key", "term"]).where("last_k >= ctx_at").groupBy("session_id", "use_id").agg(F.count(F.lit(1)).alias("own"))
    main = reach.where("ctx_key = 'main'").drop("ctx_key")
    parent = one.where("ctx_key <> 'main'").join(main, ["session_id", "term"]).where("last_k >= main_at") \
        .groupBy("session_id", "use_id").agg(F.count(F.lit(1)).alias("parent"))
    e = explored.join(own, ["session_id", "use_id"], "left").join(parent, ["session_id", "use_id"], "left")
    used = F.greatest(F.coalesce("own", F.lit(0)), F.coalesce("parent", F.lit(0))) >= W8_MIN_SHARED
    return e.groupBy("session_id", "instr").agg(F.sum(F.when(~used, F.col("tokens")).otherwise(0)).alias("w8"), F.sum("tokens").alias("w8_explore"))


def scores(instr: DataFrame, w4: DataFrame, w5: DataFrame, w8: DataFrame) -> DataFrame:
    on = ["session_id", "instr"]
    s = instr.select(*on).join(w4, on, "left").join(w5, on, "left").join(w8, on, "left").fillna(0)
    return s.withColumns({
        "flag_w5": (F.col("w5_input") > 0) & (F.col("w5") >= W5_MIN_SHARE * F.col("w5_input")),
        "flag_w8": (F.col("w8") >= W8_MIN_TOKENS) & (F.col("w8") >= W8_MIN_SHARE * F.col("w8_explore")),
        "flag_w4": F.col("w4") >= W4_MIN_TOKENS})


def flag_rows(s: DataFrame) -> DataFrame:
    flags = F.array(*[F.when(F.col(f"flag_{c.lower()}"), F.lit(c)) for c in ("W4", "W5", "W8")])
    return s.select("session_id", "instr", F.explode(F.array_compact(flags)).alias("category"))
