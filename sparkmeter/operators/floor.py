"""Mechanical waste: duplicated results (W1), failures (W2), cache churn (W6), and the floor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import scale
from ..functions.numbers import PRICE, collapse_tool, percent
from ..sources.agent_logs import main_chain
from .audit import epoch_ends

CHURN_TOLERANCE = 0.02
CAUSES = ("model_switch", "gap_under_5m", "gap_5m_to_1h", "gap_over_1h", "unknown")
LINE_ORDER = ["at", "rank", "pos"]


def judged_results(uses: DataFrame, order: list[str] = ("result_ord",), orphans: DataFrame | None = None) -> DataFrame:
    """Results labelled W1 (same call, same result, same epoch as the previous one) or W2 (error).

    `orphans`: results without their use, which are compared with nothing and can only be W2.
    """
    state = F.struct("result_hash", F.col("result_epoch").alias("e"))
    rows = uses.where("has_result")
    if "result_blk" in rows.columns:  # results are ordered by arrival, so their own block counts
        rows = rows.withColumn(scale.BLOCK, F.col("result_blk"))
    rows = scale.scan(rows, ["session_id", "ctx_key", "name", "input_sig"], list(order),
                      _prev=scale.previous(state))
    cat = F.when(F.col("_prev") == state, "W1").when(F.col("is_error"), "W2")
    rows = rows.withColumn("category", cat).drop("_prev")
    if orphans is not None:
        rows = rows.unionByName(orphans.withColumn("category", F.when(F.col("is_error"), "W2")), allowMissingColumns=True)
    return rows


def write_rate(c5: str = "cache_write", c1: str = "cache_write_1h"):
    w, h = F.col(c5), F.col(c1)
    paid = ((w - h) * PRICE["cache_write_5m"] + h * PRICE["cache_write_1h"]) / F.when(w != 0, w)
    return F.coalesce(paid, F.lit(PRICE["cache_write_5m"]))


def churn(calls: DataFrame, order: list[str] = ("k",)) -> DataFrame:
    """Main-chain calls that wrote again what the previous call had in its context."""
    c = scale.scan(main_chain(calls), ["session_id"], list(order), p_ctx=scale.previous(F.col("context")),
                   p_ts=scale.previous(F.col("ts")), p_model=scale.previous(F.col("model")))
    missed = F.least("cache_write", F.col("p_ctx") - F.col("cache_read"))
    gap = F.unix_micros("ts") - F.unix_micros("p_ts")
    cause = (F.when(F.col("p_model") != F.col("model"), CAUSES[0]).when(gap.isNull(), CAUSES[4])
             .when(gap < 300_000_000, CAUSES[1]).when(gap < 3_600_000_000, CAUSES[2]).otherwise(CAUSES[3]))
    c = c.withColumns({"tokens": missed, "rate": write_rate()})
    c = c.where((F.col("context") >= F.col("p_ctx")) & (F.col("tokens") > CHURN_TOLERANCE * F.col("p_ctx")))
    return c.withColumns({"cause": cause, "price_units": F.col("tokens") * (F.col("rate") - PRICE["cache_read"])})


def churn_by_cause(events: DataFrame) -> DataFrame:
    return events.groupBy("session_id", "cause").agg(
        F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens"), F.sum("price_units").alias("price_units"))


def price_totals(calls: DataFrame) -> DataFrame:
    """Input by price class, its price, and the mean write rate of the main chain."""
    main = F.col("ctx_key") == "main"
    c = calls.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("context").alias("input_processed"),
        F.sum("input").alias("input"), F.sum("cache_read").alias("cache_read"),
        F.sum(F.col("cache_write") - F.col("cache_write_1h")).alias("cache_write_5m"),
        F.sum("cache_write_1h").alias("cache_write_1h"),
        F.sum(F.when(main, F.col("cache_write") - F.col("cache_write_1h"))).alias("_m5"),
        F.sum(F.when(main, F.col("cache_write_1h"))).alias("_m1"),
        F.sum(F.when(~main, F.col("context"))).alias("subagent_input"))
    m = F.col("_m5") + F.col("_m1")
    rate = (F.col("_m5") * PRICE["cache_write_5m"] + F.col("_m1") * PRICE["cache_write_1h"]) / F.when(m != 0, m)
    total = sum((F.col(k) * v for k, v in PRICE.items()), F.lit(0.0))
    return c.withColumns({"write_rate": F.coalesce(rate, F.lit(PRICE["cache_write_5m"])), "price_total_units": total,
                          "subagent_input": F.coalesce("subagent_input", F.lit(0))}).drop("_m5", "_m1")


def carried_waste(judged: DataFrame, calls: DataFrame) -> DataFrame:
    """W1/W2 tokens re-read by later main calls of the same epoch."""
    main = judged.where("category IS NOT NULL AND ctx_key = 'main'")
    ends = epoch_ends(main_chain(calls))
    ends = ends.withColumnRenamed("epoch", "result_epoch")
    rows = main.join(ends, ["session_id", "result_epoch"], "left")
    later = F.greatest(F.lit(0), F.coalesce("epoch_end", F.lit(0)) - F.col("result_at"))
    return rows.groupBy("session_id", "category").agg(F.sum(F.col("text_tokens") * later).alias("carried"))


def wasted_steps(judged: DataFrame, uses: DataFrame, calls: DataFrame) -> DataFrame:
    """Calls without text whose every tool result was W1 or W2. uses: one row per tool use with
    has_text of its response; all uses count, answered or not."""
    step = ["session_id", "ctx_key", "call_k"]
    cats = judged.select("session_id", "use_id", "category")
    rows = uses.join(cats, ["session_id", "use_id"], "left")
    steps = rows.groupBy(*step).agg(
        F.bool_and(F.col("category").isNotNull()).alias("all_bad"), F.bool_and(F.coalesce(F.col("category") == "W1", F.lit(False))).alias("all_w1"),
        F.bool_or("has_text").alias("has_text"), F.collect_set(collapse_tool("name")).alias("tools"))
    steps = steps.where("all_bad AND NOT has_text")
    c = calls.select("session_id", "ctx_key", F.col("k").alias("call_k"), "context")
    return steps.join(c, step).select(*step, F.when(F.col("all_w1"), "W1").otherwise("W2").alias("category"),
                                      F.col("context").alias("input"), "tools")


def wasted_steps_by_tool(steps: DataFrame) -> DataFrame:
    rows = steps.select("category", "input", F.explode("tools").alias("name"))
    return rows.groupBy("category", "name").agg(F.count(F.lit(1)).alias("calls"), F.sum("input").alias("input"))


def floor(calls: DataFrame, judged: DataFrame, churn_events: DataFrame) -> DataFrame:
    """One row per session: removable tokens and price against everything processed."""
    def amount(c):
        return [F.sum(F.when(F.col("category") == c, F.col("text_tokens"))).alias(f"{c.lower()}_tokens"),
                F.count(F.when(F.col("category") == c, 1)).alias(f"{c.lower()}_count")]

    bad = judged.groupBy("session_id").agg(*amount("W1"), *amount("W2"))
    w6 = [F.sum("tokens").alias("w6_tokens"), F.count(F.lit(1)).alias("w6_count"), F.sum("price_units").alias("w6_price")]
    w6 += [F.sum(F.when(F.col("cause") == c, F.col("price_units"))).alias(f"w6_price_{c}") for c in CAUSES]
    out = price_totals(calls).join(bad, "session_id", "left").join(churn_events.groupBy("session_id").agg(*w6), "session_id", "left")
    return with_floor(out.fillna(0))


def with_floor(rows: DataFrame) -> DataFrame:
    removable = F.col("w1_tokens") + F.col("w2_tokens")
    out = rows.withColumn("removable_tokens", removable).withColumn("removable_price_units", removable * F.col("write_rate"))
    out = out.withColumn("floor_price_units", F.col("removable_price_units") + F.col("w6_price"))
    return out.withColumns({"floor_pct_of_input": percent("removable_tokens", "input_processed"),
                            "floor_pct_price_weighted": percent("floor_price_units", "price_total_units")})


def combine(floors: DataFrame) -> DataFrame:
    """Corpus totals and the three views of which re-writes count."""
    sums = [c for c, t in floors.dtypes if c != "session_id" and not c.endswith(("_pct_of_input", "_price_weighted")) and c != "write_rate"]
    t = floors.agg(F.count(F.lit(1)).alias("sessions"), *[F.sum(c).alias(c) for c in sums])
    base = F.col("removable_price_units")
    no_long = sum((F.col(f"w6_price_{c}") for c in CAUSES if c != "gap_over_1h"), F.lit(0.0))
    return t.withColumns({
        "floor_pct_of_input": percent("removable_tokens", "input_processed"),
        "floor_pct_price_weighted": percent("floor_price_units", "price_total_units"),
        "pct_without_gap_over_1h": percent(base + no_long, "price_total_units"),
        "pct_only_gap_under_5m": percent(base + F.col("w6_price_gap_under_5m"), "price_total_units")})


def instruction_flags(judged: DataFrame, churn_events: DataFrame) -> DataFrame:
    """(session_id, instr, category), one row per flag."""
    bad = judged.where("category IS NOT NULL").select("session_id", F.col("result_instr").alias("instr"), "category")
    w6 = churn_events.select("session_id", "instr", F.lit("W6").alias("category"))
    return bad.unionByName(w6).where("instr >= 1").distinct()
