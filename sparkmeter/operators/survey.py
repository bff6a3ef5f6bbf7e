"""Session measurements, decomposition of context, concentration, before/after summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import scale
from ..functions.numbers import collapse_tool, optimal_ceiling, percent
from ..sources.agent_logs import main_chain

IDLE_GAP_SECONDS = 30 * 60
CURVE_POINTS = 40
DEFAULT_POST_COMPACTION = 64_000
MIN_SESSIONS, MIN_INSTRUCTIONS = 5, 30


def quantiles(df: DataFrame, by: list[str], value: str, **qs: float) -> DataFrame:
    """Inclusive quantiles. Ordinary groups fit one aggregation buffer; a corpus, or a frame cut into
    blocks because some group is large, goes through ranked value runs."""
    if by and scale.BLOCK not in df.columns:
        return df.groupBy(*by).agg(*[F.percentile(value, F.lit(q)).alias(n) for n, q in qs.items()])
    return scale.exact_percentiles(df, by, value, **qs)


def measure(calls: DataFrame, uses: DataFrame, instr: DataFrame) -> DataFrame:
    """One row per session: counts, token sums, context shares, span, all of the main chain."""
    calls, uses = main_chain(calls), main_chain(uses)
    shares = [F.sum(F.when(F.col("context") >= k * 1000, F.col("context"))).alias(f"_{k}") for k in (200, 400, 600)]
    m = calls.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("api_calls"), F.sum("context").alias("input_processed"),
        F.sum("cache_read").alias("cache_read"), F.sum("cache_write").alias("cache_write"), F.sum("output").alias("output"),
        F.min_by("context", "k").alias("first_context"), F.max("context").alias("peak_context"),
        F.max("epoch").alias("compactions"), *shares,
        ((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 3.6e9).alias("span_hours"))
    t = uses.groupBy("session_id").agg(F.count(F.lit(1)).alias("tool_calls"),
                                       F.sum(F.col("is_error").cast("bigint")).alias("tool_errors"), F.sum("images").cast("bigint").alias("images"))
    i = instr.groupBy("session_id").agg(F.count(F.lit(1)).alias("user_instructions"))
    out = m.join(t, "session_id", "left").join(i, "session_id", "left").fillna(0)
    return out.withColumns({f"ge_{k}k_pct": percent(f"_{k}", "input_processed") for k in (200, 400, 600)}).drop("_200", "_400", "_600")


def top_counts(df: DataFrame, label: str, n: int) -> DataFrame:
    """The n most frequent labels of each session (tools: 25, line types: 12)."""
    counts = df.groupBy("session_id", F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("session_id").orderBy(F.desc("n"), "label")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def tool_counts(uses: DataFrame, n: int = 25) -> DataFrame:
    return top_counts(uses.withColumn("name", collapse_tool("name")), "name", n)


def per_instruction(calls: DataFrame) -> DataFrame:
    return main_chain(calls).where("instr >= 1").groupBy("session_id", "instr").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("context").alias("input"))


def active_hours(stamped: DataFrame, order: list[str] = ("ts",)) -> DataFrame:
    rows = scale.scan(stamped.where("ts IS NOT NULL"), ["session_id"], list(order), _prev=scale.previous(F.col("ts")))
    gap = F.unix_micros("ts") - F.unix_micros("_prev")
    short = F.when(gap <= IDLE_GAP_SECONDS * 1_000_000, gap)
    return rows.groupBy("session_id").agg((F.coalesce(F.sum(short), F.lit(0)) / 3.6e9).alias("active_hours"))


def context_curve(calls: DataFrame) -> DataFrame:
    """(session_id, point, k, context) at 40 evenly spaced calls of the main chain."""
    calls = main_chain(calls)
    n = calls.groupBy("session_id").agg((F.max("k") + 1).alias("n"))
    points = n.select("session_id", F.posexplode(F.sequence(F.lit(0), F.lit(CURVE_POINTS - 1))).alias("point", "_i"), "n")
    at = F.bround(F.col("point") * (F.col("n") - 1) / F.lit(float(CURVE_POINTS - 1)), 0).cast("bigint")
    points = points.select("session_id", "point", F.least(F.col("n") - 1, at).alias("k"))
    return points.join(calls.select("session_id", "k", "context"), ["session_id", "k"])


def subagent_rollup(calls: DataFrame) -> DataFrame:
    return calls.groupBy("session_id", "is_side").agg(
        F.count(F.lit(1)).alias("api_calls"), F.sum("context").alias("input_processed"), F.sum("cache_read").alias("cache_read"),
        F.sum("cache_write").alias("cache_write"), F.sum("output").alias("output"))


def decomposed_calls(calls: DataFrame, base: DataFrame | None = None, order: list[str] = ("k",)) -> DataFrame:
    """Every main-chain call's context as fixed base, carried over from earlier instructions, and current."""
    c = scale.scan(main_chain(calls), ["session_id"], list(order), _pi=scale.previous(F.col("instr")),
                   _base=scale.last_known(F.when(F.col("k") == 0, F.col("context"))))
    opens = F.col("_pi").isNull() | (F.col("_pi") != F.col("instr"))
    c = scale.scan(c, ["session_id"], list(order), _start=scale.last_known(F.when(opens, F.col("context"))))
    if base is not None:
        c = c.join(base.select("session_id", "base_override"), "session_id", "left")
        c = c.withColumn("_base", F.coalesce("base_override", "_base")).drop("base_override")
    c = c.withColumns({"fixed": F.least("context", "_base"),
                       "carried": F.greatest(F.lit(0), F.least("context", "_start") - F.col("_base"))})
    return c.withColumn("current", F.col("context") - F.col("fixed") - F.col("carried")).drop("_pi", "_start")


def decompose(calls: DataFrame, base: DataFrame | None = None, order: list[str] = ("k",)) -> DataFrame:
    return decomposed_calls(calls, base, order).groupBy("session_id").agg(
        F.sum("fixed").alias("fixed"), F.sum("carried").alias("carried"), F.sum("current").alias("current"))


def concentration(instr: DataFrame, fractions=(0.01, 0.05, 0.10, 0.20, 0.50)) -> DataFrame:
    """Share of all input spent by the largest share of instructions. Exact over value runs, so no
    ordering of all rows in one task."""
    runs = scale.value_ranks(instr.withColumn("_v", -F.col("input")), [], "_v")  # largest first
    k = {f: F.greatest(F.lit(1), F.bround(F.lit(f) * F.col("total"), 0)) for f in fractions}
    aggs = [F.sum(-F.col("_v") * F.least("copies", F.greatest(F.lit(0), k[f] - F.col("before"))).cast("bigint")).alias(f"_{i}")
            for i, f in enumerate(fractions)]
    t = runs.agg(F.sum(-F.col("_v") * F.col("copies")).alias("_t"), *aggs)
    rows = F.array(*[F.struct(F.lit(f).alias("fraction"), (F.col(f"_{i}") / F.col("_t")).alias("share")) for i, f in enumerate(fractions)])
    return t.select(F.inline(rows))


def cumulative_shares(instr: DataFrame) -> DataFrame:
    """(input, n, cum_share): the concentration curve, one row per distinct value."""
    runs = scale.value_ranks(instr.withColumn("_v", -F.col("input")), [], "_v").select((-F.col("_v")).alias("input"), "_v", F.col("copies").alias("n"), scale.BLOCK)
    runs = scale.scan(runs, [], ["_v"], _c=scale.running_sum(F.col("input") * F.col("n")))
    total = instr.agg(F.sum("input").alias("_t"))
    return runs.join(F.broadcast(total)).select("input", "n", (F.col("_c") / F.col("_t")).alias("cum_share"))  # one row


def derive(measures: DataFrame, decomposition: DataFrame) -> DataFrame:
    d = decomposition.agg(*[F.sum(c).alias(c) for c in ("fixed", "carried", "current")])
    m = measures.agg(
        F.count(F.lit(1)).alias("sessions"), F.sum("input_processed").alias("total_input"),
        F.sum("user_instructions").alias("instructions"), F.sum("api_calls").alias("calls"),
        F.min(F.try_divide("output", "input_processed")).alias("output_ratio_low"),
        F.max(F.try_divide("output", "input_processed")).alias("output_ratio_high"))
    m = m.withColumn("per_instruction_mean", F.coalesce(F.try_divide("total_input", "instructions"), F.lit(0.0)))
    return m.join(F.broadcast(d))  # one row each


def ranked_sessions(measures: DataFrame, n: int = 5) -> DataFrame:
    """The n largest sessions and their share of all input."""
    total = measures.agg(F.sum("input_processed").alias("_t"))
    top = measures.orderBy(F.desc("input_processed"), "session_id").limit(n)
    return top.join(F.broadcast(total)).select("session_id", "input_processed", (F.col("input_processed") / F.col("_t")).alias("share"))


def growth(calls: DataFrame, order: list[str] = ("k",)) -> DataFrame:
    c = scale.scan(calls, ["session_id"], list(order), _p=scale.previous(F.col("context")))
    up = F.when(F.col("context") > F.col("_p"), F.col("context") - F.col("_p")).otherwise(0)
    return c.groupBy("session_id").agg(F.sum(up).alias("growth_sum"), F.count(F.lit(1)).alias("growth_steps"))


def ceiling_model(growths: DataFrame, post: int = DEFAULT_POST_COMPACTION, reread: float = 0.0) -> DataFrame:
    g = growths.agg((F.sum("growth_sum") / F.sum("growth_steps")).alias("growth_per_call"))
    return g.select("growth_per_call", F.lit(float(post)).alias("post_compaction"),
                    optimal_ceiling(F.lit(float(post)), "growth_per_call", F.lit(reread)).alias("optimum"))


def observed_post(calls: DataFrame, order: list[str] = ("k",)) -> DataFrame:
    """Median context right after a session's own compactions (a drop below half)."""
    c = scale.scan(calls, ["session_id"], list(order), _p=scale.previous(F.col("context")))
    drops = c.where(F.col("context") < F.col("_p") / 2).drop(scale.BLOCK)
    med = drops.groupBy("session_id").agg(F.percentile("context", F.lit(0.5)).cast("bigint").alias("post"))
    ids = calls.select("session_id").distinct()
    return ids.join(med, "session_id", "left").withColumn("post", F.coalesce("post", F.lit(DEFAULT_POST_COMPACTION)))


# ---------------------------------------------------------------- before / after


def summarize_sides(calls: DataFrame, floors: DataFrame | None = None, order: list[str] = ("k",)) -> DataFrame:
    """One row per ``side`` (a column of calls) over the main chains of sessions that have one.

    Sub-agents' calls are only counted. floors, one row a session with its side, is used only if both sides have
    it; its calls take in sub-agents.
    """
    main = main_chain(calls)
    instr = main.where("instr >= 1").groupBy("side", "session_id", "instr").agg(F.count(F.lit(1)).alias("calls"), F.sum("context").alias("input"))
    is_main = F.col("ctx_key") == "main"
    per = calls.groupBy("side", "session_id").agg(F.count(F.when(is_main, 1)).alias("calls"), F.count(F.when(~is_main, 1)).alias("sub_calls"), F.max(F.when(is_main, F.col("epoch"))).alias("comps")).where("calls > 0")
    n_instr = instr.groupBy("side", "session_id").agg(F.count(F.lit(1)).alias("n_instr"))
    per = per.join(n_instr, ["side", "session_id"], "left").fillna(0)
    s = per.groupBy("side").agg(
        F.count(F.lit(1)).alias("sessions"), F.sum("calls").alias("calls"), F.sum("sub_calls").alias("subagent_calls"), F.sum("n_instr").alias("instructions"),
        (1000 * F.sum("comps") / F.sum("calls")).alias("compactions_per_1000_calls"),
        (F.sum("n_instr") / F.count(F.lit(1))).alias("instructions_per_session"))
    dec = decomposed_calls(main, order=order).groupBy("side").agg(
        (F.sum("carried") / F.sum("context")).alias("carried_share"))
    s = s.join(dec, "side")
    for df, value, name in ((instr, "input", "median_input_per_instruction"), (instr, "calls", "median_steps_per_instruction"),
                            (main, "context", "median_context_per_call"), (per, "n_instr", "instructions_per_session_median")):
        s = s.join(scale.exact_percentiles(df, ["side"], value, **{name: 0.5}), "side", "left")
    if floors is not None:
        f = floors.groupBy("side").agg(
            percent(F.sum("floor_price_units"), F.sum("price_total_units")).alias("removable_cost_pct"),
            percent(F.sum("removable_tokens"), F.sum("input_processed")).alias("removable_tokens_pct"),
            (1000 * F.sum("w1_count") / F.sum("calls")).alias("w1_per_1000_calls"))
        both = f.agg((F.count(F.lit(1)) == 2).alias("_both"))
        f = f.join(F.broadcast(both))  # one row
        f = f.select("side", *[F.when(F.col("_both"), F.col(c)).alias(c) for c in f.columns[1:-1]])
        s = s.join(f, "side", "left")
    return s.withColumn("too_small", (F.col("sessions") < MIN_SESSIONS) | (F.col("instructions") < MIN_INSTRUCTIONS))


def side_models(calls: DataFrame) -> DataFrame:
    """(side, model, sessions): each session counts for the model of most of its main-chain calls, of equal ones the first used."""
    used = main_chain(calls).groupBy("side", "session_id", F.coalesce("model", F.lit("?")).alias("model")).agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("first_k"))
    own = used.groupBy("side", "session_id").agg(F.max_by("model", F.struct("n", -F.col("first_k"))).alias("model"))
    return own.groupBy("side", "model").agg(F.count(F.lit(1)).alias("sessions"))


def ratios(sides: DataFrame, measures: list[str]) -> DataFrame:
    """(measure, before, after, ratio); null when the before value is null or 0."""
    long = sides.select("side", F.inline(F.array(*[
        F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("v")) for m in measures])))
    r = long.groupBy("measure").agg(F.max(F.when(F.col("side") == "before", F.col("v"))).alias("before"),
                                    F.max(F.when(F.col("side") == "after", F.col("v"))).alias("after"))
    return r.withColumn("ratio", F.try_divide("after", "before"))
