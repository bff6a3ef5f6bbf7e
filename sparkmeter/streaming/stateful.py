"""Stateful streams: re-read guard, cache-churn and ceiling alerts, duplicate requests.

State is kept per small key (one read key, one session, one request key), each a few numbers, and times
out with the watermark, so it stays bounded whatever the stream's length. Rows of a key in one batch are
read in time order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.numbers import PRICE
from ..operators.floor import CHURN_TOLERANCE

LATE = "10 minutes"


def _ordered(batches: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(batches)).sort_values(by, kind="stable")


def reread_guard(events: DataFrame, late: str = LATE, idle_ms: int = 24 * 3600 * 1000) -> DataFrame:
    """Decisions about reads: deny once when the file is unchanged since the last read of the same range
    and no compaction came in between; otherwise allow.

    events: (session_id, agent_id, path, read_range, size, mtime, compactions, ts, estimate). compactions
    counts the session's compactions so far, so a compaction makes the remembered read stale without a
    second stream. Rows older than the watermark never reach the state: they are allowed by not being
    denied.
    """
    key = ["session_id", "agent_id", "path", "read_range"]
    out = "session_id string, agent_id string, path string, read_range string, ts timestamp, decision string, avoided bigint"

    def decide(k, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        seen, denied = state.get if state.exists else ("", False)
        rows = []
        pdf = _ordered(batches, ["ts"])
        for r in pdf.itertuples(index=False):
            sig = f"{r.size}|{r.mtime}|{r.compactions}"
            deny = sig == seen and not denied
            rows.append((*k, r.ts, "deny" if deny else "allow", int(r.estimate) if deny else 0))
            seen, denied = sig, deny
        state.update((seen, denied))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), int(pdf["ts"].iloc[-1].timestamp() * 1000)) + idle_ms)
        yield pd.DataFrame(rows, columns=[*key, "ts", "decision", "avoided"])

    return events.withWatermark("ts", late).groupBy(*key).applyInPandasWithState(
        decide, out, "seen string, denied boolean", "append", GroupStateTimeout.EventTimeTimeout)


class _SessionGuard(StatefulProcessor):
    """Reads of one session: the file's state when last read, and which reads were denied once."""

    KEY, SEEN = "agent_id string, path string, read_range string", "size bigint, mtime bigint"

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.reads = handle.getMapState("reads", self.KEY, self.SEEN)
        self.denied = handle.getMapState("denied", self.KEY, "denied boolean")

    def _forget(self) -> None:
        self.reads.clear()
        self.denied.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows))
        pdf = pdf.assign(_read=pdf["kind"] != "compact").sort_values(["ts", "_read"], kind="stable")  # of one instant the compaction first
        out = []
        for r in pdf.itertuples(index=False):
            if r.kind == "compact":
                self._forget()
                continue
            at, sig = (r.agent_id, r.path, r.read_range), (int(r.size), int(r.mtime))
            deny = self.reads.containsKey(at) and tuple(self.reads.getValue(at)) == sig and not self.denied.containsKey(at)
            if deny:
                self.denied.updateValue(at, (True,))
            else:
                self.reads.updateValue(at, sig)
                if self.denied.containsKey(at):
                    self.denied.removeKey(at)
            out.append((*key, *at, r.ts, "deny" if deny else "allow", int(r.estimate) if deny else 0))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(max(timerValues.getCurrentWatermarkInMs(), int(pdf["ts"].iloc[-1].timestamp() * 1000)) + self.idle_ms)
        yield pd.DataFrame(out, columns=["session_id", "agent_id", "path", "read_range", "ts", "decision", "avoided"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._forget()
        yield pd.DataFrame([], columns=["session_id", "agent_id", "path", "read_range", "ts", "decision", "avoided"])

    def close(self) -> None:
        pass


def session_guard(events: DataFrame, late: str = LATE, idle_ms: int = 24 * 3600 * 1000) -> DataFrame:
    """Decisions about reads, with the session's compactions as events of the same stream.

    events: (session_id, kind 'read' or 'compact', agent_id, path, read_range, size, mtime, ts, estimate). A read is denied
    once if its file is unchanged since the last read of the same range; a compaction takes earlier reads out of the context,
    so the whole session is forgotten. A session idle for `idle_ms` of event time is forgotten by its timer. Rows older than
    the watermark never reach the state: they are allowed by not being denied. State lives in RocksDB, as this operator needs.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out = "session_id string, agent_id string, path string, read_range string, ts timestamp, decision string, avoided bigint"
    rows = events.withColumns({c: F.coalesce(c, F.lit("")) for c in ("agent_id", "path", "read_range")} | {c: F.coalesce(c, F.lit(0)) for c in ("size", "mtime", "estimate")})
    return rows.withWatermark("ts", late).groupBy("session_id").transformWithStateInPandas(_SessionGuard(idle_ms), out, "append", "eventTime")


def churn_alerts(calls: DataFrame, late: str = LATE, idle_ms: int = 24 * 3600 * 1000) -> DataFrame:
    """Cache re-writes as calls arrive. calls: (session_id, ts, model, context, cache_read, cache_write, rate)."""
    out = "session_id string, ts timestamp, tokens bigint, price_units double, cause string"

    def run(k, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        prev = state.get if state.exists else None
        rows = []
        pdf = _ordered(batches, ["ts"])
        for r in pdf.itertuples(index=False):
            if prev is not None:
                ctx, at, model = prev
                missed = min(r.cache_write, ctx - r.cache_read)
                if r.context >= ctx and missed > CHURN_TOLERANCE * ctx:
                    gap = r.ts.timestamp() - at
                    cause = "model_switch" if model != r.model else "gap_under_5m" if gap < 300 else "gap_5m_to_1h" if gap < 3600 else "gap_over_1h"
                    rows.append((k[0], r.ts, int(missed), float(missed * (r.rate - PRICE["cache_read"])), cause))
            prev = (int(r.context), float(r.ts.timestamp()), r.model)
        state.update(prev)
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), int(prev[1] * 1000)) + idle_ms)
        yield pd.DataFrame(rows, columns=["session_id", "ts", "tokens", "price_units", "cause"])

    return calls.withWatermark("ts", late).groupBy("session_id").applyInPandasWithState(
        run, out, "context bigint, at double, model string", "append", GroupStateTimeout.EventTimeTimeout)


def ceiling_alerts(calls: DataFrame, threshold: int, late: str = LATE, idle_ms: int = 24 * 3600 * 1000) -> DataFrame:
    """A suggestion to start afresh when an instruction begins and the context is above the threshold.
    calls: (session_id, ts, context, opens) where opens marks an instruction's first call."""
    out = "session_id string, ts timestamp, context bigint"

    def run(k, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else 0
        rows = []
        pdf = _ordered(batches, ["ts"])
        for r in pdf.itertuples(index=False):
            if r.opens and last > threshold:
                rows.append((k[0], r.ts, int(last)))
            last = int(r.context)
        state.update((last,))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), int(pdf["ts"].iloc[-1].timestamp() * 1000)) + idle_ms)
        yield pd.DataFrame(rows, columns=["session_id", "ts", "context"])

    return calls.withWatermark("ts", late).groupBy("session_id").applyInPandasWithState(
        run, out, "context bigint", "append", GroupStateTimeout.EventTimeTimeout)


def duplicate_requests(requests: DataFrame, ttl_seconds: float = 7 * 24 * 3600, late: str = LATE) -> DataFrame:
    """(request_id, hit): a request hits while the last miss of its key is at most ttl old.
    requests: (key, request_id, ts)."""
    def run(k, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        miss = state.get[0] if state.exists else None
        rows = []
        for r in _ordered(batches, ["ts", "request_id"]).itertuples(index=False):
            at = r.ts.timestamp()
            hit = miss is not None and at - miss <= ttl_seconds
            miss = miss if hit else at
            rows.append((r.request_id, hit))
        state.update((float(miss),))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, int((miss + ttl_seconds) * 1000) + 1))
        yield pd.DataFrame(rows, columns=["request_id", "hit"])

    return requests.withWatermark("ts", late).groupBy("key").applyInPandasWithState(
        run, "request_id bigint, hit boolean", "miss double", "append", GroupStateTimeout.EventTimeTimeout)
