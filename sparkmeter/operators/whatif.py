"""Counterfactual replays of the per-call context series: restarts, ceilings, sweeps."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import scale
from ..sources.agent_logs import main_chain
from .survey import observed_post

# --- fixed values ---------------------------------------------------------------------------
COMPACT_IF_AT_LEAST = 0.9
SUMMARIES = (2_000, 10_000, 30_000)
CAPS = (100_000, 200_000, 400_000)
EVERY = (3, 5, 10)
THRESHOLDS = (200_000, 400_000)
SWEEP = (100_000, 150_000, 200_000, 300_000, 400_000, 600_000)
POST_COMPACTION_NEW = 22_000
COMPACTION_PREFIX = 42_000
SUMMARY = 10_000
# ---------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Scenario:
    """A restart begins at base + summary. Without a ceiling, the session's largest context is the
    ceiling and its own observed size after compaction is the landing size."""

    name: str
    summary: int = SUMMARY
    every: int | None = None
    threshold: int | None = None
    ceiling: int | None = None
    post: int | None = None  # landing size after a compaction; None: observed, or base + summary if capped
    capped: bool = False


def task_scoped(summary: int) -> Scenario:
    return Scenario(f"task_scoped_summary_{summary}", summary, every=1)


def standard_scenarios() -> list[Scenario]:
    out = [task_scoped(m) for m in SUMMARIES]
    out += [Scenario(f"cap_{c}_summary_{SUMMARY}", ceiling=c, capped=True) for c in CAPS]
    out += [Scenario(f"restart_every_{n}_summary_{SUMMARY}", every=n) for n in EVERY]
    out += [Scenario(f"restart_above_{x}_summary_{SUMMARY}", threshold=x) for x in THRESHOLDS]
    out += [Scenario(f"ceiling_{c}", ceiling=c, post=COMPACTION_PREFIX + POST_COMPACTION_NEW, capped=True) for c in SWEEP]
    return out


STATE = "struct<s:bigint,total:bigint,restarts:bigint,compactions:bigint,peak:bigint>"


def _state(s: Column, total: Column, restarts: Column, compactions: Column, peak: Column) -> Column:
    return F.struct(s.alias("s"), total.alias("total"), restarts.alias("restarts"), compactions.alias("compactions"), peak.alias("peak")).cast(STATE)


def series(calls: DataFrame, base: DataFrame | None = None, order: list[str] = ("k",)) -> DataFrame:
    """Per main-chain call: context, change, instruction position; per session: base, peak, post size."""
    calls = main_chain(calls)
    c = scale.scan(calls, ["session_id"], list(order), prev=scale.previous(F.col("context")), _pi=scale.previous(F.col("instr")))
    opens = F.col("_pi").isNull() | (F.col("_pi") != F.col("instr"))
    c = c.withColumn("opens", opens)
    c = scale.scan(c, ["session_id"], list(order), nth=scale.running_sum(F.col("opens").cast("bigint"), inclusive=False))
    s = calls.groupBy("session_id").agg(F.min_by("context", "k").alias("base"), F.max("context").alias("ceiling"))
    s = s.join(observed_post(calls, order), "session_id")
    if base is not None:
        s = s.join(base.select("session_id", "base_override"), "session_id", "left")
        s = s.withColumn("base", F.coalesce("base_override", "base")).drop("base_override")
    keep = [scale.BLOCK] if scale.BLOCK in c.columns else []
    c = c.select(*keep, "session_id", "k", "context", "prev", F.when(F.col("opens"), F.col("nth")).alias("nth"))
    return c.join(s, "session_id")


def replay(ser: DataFrame, scenarios: list[Scenario], block_rows: int = 20_000) -> DataFrame:
    """(session_id, scenario, input, restarts, compactions, peak) of every scenario in one fold.

    The state of all scenarios moves together through one array per block, so rows are not
    multiplied by scenarios.
    """
    def none(x):
        return F.lit(x).cast("bigint")

    rules = F.array(*[F.struct(
        none(sc.every).alias("every"), none(sc.threshold).alias("threshold"),
        (F.col("base") + sc.summary).alias("fresh"),
        (F.col("ceiling") if sc.ceiling is None else none(sc.ceiling)).alias("ceiling"),
        (none(sc.post) if sc.post is not None else (F.col("base") + sc.summary) if sc.capped else F.col("post")).alias("post"))
        for sc in scenarios])
    zero = F.lit(0)
    rows = ser.withColumn("_rules", rules)
    first = F.array(*[_state(zero, zero, zero, zero, zero) for _ in scenarios])
    guess = F.array(*[_state(F.col("prev"), zero, zero, zero, zero) for _ in scenarios])
    item = F.struct(F.col("context").alias("x"), F.col("prev").alias("prev"), F.col("nth").alias("nth"))

    def let(value: Column, body) -> Column:
        """Bind a value once; lambda bodies are evaluated as written, without common subexpressions."""
        return F.element_at(F.transform(F.array(value), body), 1)

    no = F.lit(False)

    def one(st: Column, r: Column, e: Column) -> Column:
        d = e["x"] - e["prev"]
        dropped = F.when(st["s"] >= COMPACT_IF_AT_LEAST * e["prev"], F.least(st["s"], e["x"])).otherwise(st["s"])
        reach = F.struct(d.alias("d"), F.when(d >= 0, st["s"] + d).otherwise(dropped).alias("cont"),
                         (r["fresh"] + F.greatest(zero, d)).alias("begun"), (r["post"] + F.least(d, r["ceiling"])).alias("landed"))

        def choose(v: Column) -> Column:
            due = (e["nth"] > 0) & (F.coalesce(e["nth"] % r["every"] == 0, no) | F.coalesce(st["s"] > r["threshold"], no))
            go = F.coalesce(due & (v["begun"] < v["cont"]), no)
            full = F.coalesce((v["d"] >= 0) & (v["cont"] > r["ceiling"]) & (v["landed"] < v["cont"]), no)
            # 0 first call, 1 restart, 2 compaction, 3 go on
            return let(F.when(v["d"].isNull(), 0).when(go, 1).when(full, 2).otherwise(3), lambda c: settle(v, c))

        def settle(v: Column, c: Column) -> Column:
            s = F.when(c == 0, e["x"]).when(c == 1, v["begun"]).when(c == 2, v["landed"]).otherwise(v["cont"])
            return let(s, lambda s: _state(s, st["total"] + s + F.when(c == 2, v["cont"]).otherwise(zero), st["restarts"] + F.when(c == 1, 1).otherwise(0),
                                           st["compactions"] + F.when(c == 2, 1).otherwise(0), F.greatest(st["peak"], s)))

        return let(reach, choose)

    def step(state: Column, e: Column, p: Column) -> Column:
        return F.zip_with(state, p["_rules"], lambda st, r: one(st, r, e))

    def hand_over(state: Column) -> Column:
        return F.transform(state, lambda st: _state(st["s"], zero, zero, zero, zero))

    done = scale.fold(rows, ["session_id"], "k", item, [F.col("_rules")], first, guess, step, hand_over, block_rows)
    names = F.array(*[F.lit(sc.name) for sc in scenarios])
    long = done.select("session_id", F.inline(F.arrays_zip(names.alias("scenario"), F.col("state").alias("st"))))
    return long.groupBy("session_id", "scenario").agg(
        F.sum("st.total").alias("input"), F.sum("st.restarts").alias("restarts"), F.sum("st.compactions").alias("compactions"),
        F.max("st.peak").alias("peak"))


def sweep(calls: DataFrame, scenarios: list[Scenario] | None = None, base: DataFrame | None = None, order: list[str] = ("k",)) -> DataFrame:
    """(scenario, input, measured, saved_pct) pooled over sessions."""
    r = replay(series(calls, base, order), scenarios or standard_scenarios())
    m = main_chain(calls).agg(F.sum("context").alias("measured"))
    t = r.groupBy("scenario").agg(F.sum("input").alias("input"), F.sum("restarts").alias("restarts"), F.sum("compactions").alias("compactions"))
    return t.join(F.broadcast(m)).withColumn("saved_pct", 100 * (1 - F.col("input") / F.col("measured")))  # one row
