"""Where an agent session's tokens went: totals, repeated reads, failures, carried results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import scale
from ..functions.numbers import collapse_tool, percent
from ..sources.agent_logs import WRITERS, main_chain

LARGE_RESULT_TOKENS = 2000
LONG_CONTEXT = 120_000
LINE_ORDER = ["at", "rank", "pos", "bpos"]


def session_totals(calls: DataFrame) -> DataFrame:
    t = calls.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("api_calls"), F.sum("input").alias("input"), F.sum("cache_read").alias("cache_read"),
        F.sum("cache_write").alias("cache_write"), F.sum("output").alias("output"),
        F.sum("context").alias("processed_input"), F.max("context").alias("peak_context"))
    return t.withColumns({"cache_hit_pct": percent("cache_read", "processed_input"),
                          "avg_context": F.col("processed_input") / F.col("api_calls")})


def epoch_ends(calls: DataFrame) -> DataFrame:
    """(session_id, epoch, epoch_end): first call index after each stretch between compactions."""
    return calls.groupBy("session_id", "epoch").agg((F.max("k") + 1).alias("epoch_end"))


def with_carry(uses: DataFrame, calls: DataFrame) -> DataFrame:
    """carried: later calls that re-read something added at call k, until the next compaction."""
    out = uses.join(epoch_ends(calls), ["session_id", "epoch"], "left")
    later = F.greatest(F.lit(0), F.coalesce("epoch_end", F.lit(0)) - F.col("k") - 1)
    return out.withColumn("carried_tokens", F.col("result_tokens") * later).drop("epoch_end")


def duplicate_reads(uses: DataFrame, order: list[str] = LINE_ORDER) -> DataFrame:
    """Reads of the same range of a file, with neither a write to it nor a compaction in between."""
    wrote = F.col("name").isin(WRITERS)
    read = (F.col("name") == "Read") & F.col("has_result") & ~F.col("is_error")
    rows = uses.where((wrote & F.col("path").isNotNull()) | read)
    rows = scale.scan(rows, ["session_id", "path"], order, _writes=scale.running_sum(wrote.cast("bigint")))
    state = F.struct("_writes", "epoch")
    rows = scale.scan(rows.where(read), ["session_id", "path", "read_range"], order, _prev=scale.previous(state))
    return rows.where(F.col("_prev") == state).drop("_prev", "_writes")


def large_results(uses: DataFrame, threshold: int = LARGE_RESULT_TOKENS) -> DataFrame:
    return uses.where(F.col("has_result") & (F.col("result_tokens") >= threshold))


def failed_repeats(uses: DataFrame, order: list[str] = LINE_ORDER) -> DataFrame:
    """A failing call whose previous call with the same input failed too."""
    rows = scale.scan(uses.where("has_result"), ["session_id", "name", "input_sig"], order,
                      _failed=scale.previous(F.col("is_error")))
    return rows.where(F.col("is_error") & F.col("_failed")).drop("_failed")


def cost(items: DataFrame, prefix: str) -> DataFrame:
    return items.groupBy("session_id").agg(
        F.count(F.lit(1)).alias(f"{prefix}_count"), F.sum("result_tokens").alias(f"{prefix}_tokens"),
        F.sum("carried_tokens").alias(f"{prefix}_carried"))


def by_tool(uses: DataFrame) -> DataFrame:
    """uses: with carried_tokens."""
    return uses.groupBy("session_id", "name").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("result_tokens").alias("result_tokens"),
        F.sum("carried_tokens").alias("carried_tokens"), F.sum(F.col("is_error").cast("bigint")).alias("errors"),
        F.sum("images").cast("bigint").alias("images"))


PARTS = ("dup", "large", "failed")


def audit(calls: DataFrame, uses: DataFrame, order: list[str] = LINE_ORDER, large: int = LARGE_RESULT_TOKENS) -> DataFrame:
    """One row per session with main-chain calls; sub-agent calls are only counted, in subagent_calls."""
    side = calls.where("ctx_key <> 'main'").groupBy("session_id").agg(F.count(F.lit(1)).alias("subagent_calls"))
    calls, uses = main_chain(calls), main_chain(uses)
    uses = with_carry(uses, calls)
    out = session_totals(calls).join(side, "session_id", "left")
    tools = uses.groupBy("session_id").agg(F.count(F.lit(1)).alias("tool_calls"), F.sum("carried_tokens").alias("carried_tokens"))
    comps = calls.groupBy("session_id").agg(F.max("epoch").alias("compactions"))
    out = out.join(tools, "session_id", "left").join(comps, "session_id", "left")
    for prefix, items in zip(PARTS, (duplicate_reads(uses, order), large_results(uses, large), failed_repeats(uses, order))):
        out = out.join(cost(items, prefix), "session_id", "left")
    return out.fillna(0)


def merge(audits: DataFrame) -> DataFrame:
    """All sessions; percentages recomputed from the sums."""
    sums = ["api_calls", "subagent_calls", "tool_calls", "compactions", "input", "cache_read", "cache_write", "output", "processed_input",
            "carried_tokens"] + [f"{p}_{m}" for p in PARTS for m in ("count", "tokens", "carried")]
    m = audits.agg(F.count(F.lit(1)).alias("sessions"), F.max("peak_context").alias("peak_context"),
                   *[F.sum(c).alias(c) for c in sums])
    return m.withColumns({"cache_hit_pct": percent("cache_read", "processed_input"),
                          "carried_share_pct": percent("carried_tokens", "processed_input")})


def tool_rollup(by_tool_rows: DataFrame) -> DataFrame:
    """Per tool and overall in one pass (grouping sets); the overall row has a null name."""
    m = ["calls", "result_tokens", "carried_tokens", "errors", "images"]
    return by_tool_rows.groupingSets([["name"], []], "name").agg(
        F.grouping("name").cast("bigint").alias("is_total"), *[F.sum(c).alias(c) for c in m])


def tips(merged: DataFrame) -> DataFrame:
    """(code, weight, n, tokens), heaviest first; works on one merged row or one row per session."""
    keys = [c for c in ("session_id",) if c in merged.columns]
    n = {p: F.col(f"{p}_count") for p in PARTS}
    rows = F.array(
        F.struct(F.lit("dup_read").alias("code"), F.col("dup_carried").alias("weight"), n["dup"].alias("n"), F.col("dup_tokens").alias("tokens")),
        F.struct(F.lit("large_output").alias("code"), F.col("large_carried").alias("weight"), n["large"].alias("n"), F.col("large_tokens").alias("tokens")),
        F.struct(F.lit("failed_repeat").alias("code"), (F.col("failed_carried") + F.col("failed_tokens")).alias("weight"),
                 n["failed"].alias("n"), F.col("failed_tokens").alias("tokens")),
        F.struct(F.lit("long_session").alias("code"), F.col("peak_context").alias("weight"),
                 (F.col("peak_context") > LONG_CONTEXT).cast("bigint").alias("n"), F.col("peak_context").alias("tokens")))
    return merged.select(*keys, F.inline(rows)).where("n > 0")


def export(merged: DataFrame, tools: DataFrame, bound: DataFrame | None = None) -> DataFrame:
    """Numbers only: fixed columns and tool names with private services collapsed. `bound`: one row, packed as JSON."""
    keep = ["sessions", "api_calls", "subagent_calls", "compactions", "tool_calls", "input", "cache_read", "cache_write", "output",
            "processed_input", "cache_hit_pct", "peak_context", "carried_share_pct"]
    keep += [f"{p}_{m}" for p in PARTS for m in ("count", "tokens", "carried")]
    m = ["calls", "result_tokens", "carried_tokens", "errors", "images"]
    per_tool = tools.groupBy(collapse_tool("name").alias("name")).agg(*[F.sum(c).alias(c) for c in m])
    packed = per_tool.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", F.struct(*m)))))).alias("by_tool"))
    out = merged.select(*keep).join(F.broadcast(packed))  # one row each; names are tool types
    return out if bound is None else out.join(F.broadcast(bound.select(F.to_json(F.struct(*bound.columns)).alias("bound"))))


def top_paths(dups: DataFrame, n: int = 10) -> DataFrame:
    counts = dups.groupBy("session_id", "path").agg(F.count(F.lit(1)).alias("reads"))
    w = Window.partitionBy("session_id").orderBy(F.desc("reads"), "path")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def top_results(large: DataFrame, n: int = 10, tie: list[str] = LINE_ORDER) -> DataFrame:
    w = Window.partitionBy("session_id").orderBy(F.desc("result_tokens"), F.desc("name"), *tie)
    return large.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n) \
        .select("session_id", "rank", "name", "path", "result_tokens")
