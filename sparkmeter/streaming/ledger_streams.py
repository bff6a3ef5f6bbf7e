"""Streams over ledger rows and request logs. Each function takes a streaming (or static) DataFrame and
returns one; ``start`` writes it out with a checkpoint folder of its own."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.numbers import PRICE
from ..functions.text import estimate_tokens
from ..operators.ledger import COUNTS, parse_chunk

LATE = "2 hours"


def start(df: DataFrame, sink: str, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """File sinks keep exactly-once output through the checkpoint; available data is processed and the query ends."""
    return df.writeStream.outputMode(mode).format(sink).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _sums():
    return [F.count(F.lit(1)).alias("requests"), *[F.sum(c).alias(c) for c in COUNTS], F.sum("measured").alias("measured_requests")]


def running_totals(ledger: DataFrame) -> DataFrame:
    """Totals so far per provider, model and action (update or complete mode)."""
    return ledger.groupBy("provider", "model", "action").agg(*_sums())


def daily_export(ledger: DataFrame, late: str = LATE) -> DataFrame:
    """One row per day and group once the watermark passes the day's end; later rows are dropped."""
    g = ledger.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "provider", "model", "action").agg(*_sums())
    return g.withColumn("day", F.to_date("window.start")).drop("window", "cached_input_tokens")


def sliding_spend(ledger: DataFrame, late: str = LATE) -> DataFrame:
    """Tokens spent in the last hour, every five minutes."""
    g = ledger.withWatermark("ts", late).groupBy(F.window("ts", "1 hour", "5 minutes"), "provider").agg(F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"))
    return g.select("window.start", "window.end", "provider", "tokens")


def activity_windows(events: DataFrame, late: str = LATE) -> DataFrame:
    """Stretches of activity of a session, ended by thirty idle minutes. events: (session_id, ts)."""
    g = events.withWatermark("ts", late).groupBy("session_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("calls"), F.max("ts").alias("last"))
    # the window runs thirty minutes past its last event
    return g.select("session_id", F.col("w.start").alias("start"), "last", "calls", ((F.unix_micros("last") - F.unix_micros(F.col("w.start"))) / 3.6e9).alias("hours"))


def first_usage(lines: DataFrame, late: str = LATE) -> DataFrame:
    """One usage per response: repeated lines of a message inside the watermark are dropped."""
    return lines.withWatermark("ts", late).dropDuplicatesWithinWatermark(["session_id", "msg_key"])


def metered(chunks: DataFrame, late: str = "10 minutes", late_ms: int = 600_000, silent_ms: int = 1_800_000) -> DataFrame:
    """One row of usage per streamed reply, pauses included: the last report of each number, else estimates.

    chunks: (request_id, provider, seq, data, ts, input_estimate), the estimate of the request's input on any chunk or none.
    A reply is given out when the watermark is `late_ms` past its end mark, so that chunks which come out of order still
    count, or, without an end mark, when it has been silent for `silent_ms`; only what comes after that is a row of its own.
    """
    if "input_estimate" not in chunks.columns:
        chunks = chunks.withColumn("input_estimate", F.lit(None).cast("bigint"))
    p = parse_chunk(chunks.withColumn("seq", F.col("seq").cast("bigint"))).select("request_id", "seq", "ts", "u_input", "u_output", "said", "is_end", "input_estimate").withWatermark("ts", late)
    numbers, never = ["u_input", "u_output", "input_estimate"], -(1 << 62)

    def take(k, batches, state: GroupState):
        parts, held, ended = state.get if state.exists else ([], [None, never] * len(numbers), False)
        if state.hasTimedOut:
            state.remove()
            text = "".join(t for _, t in sorted(map(tuple, parts)))
            yield pd.DataFrame({"request_id": [k[0]], **{c: pd.array([held[2 * i]], "Int64") for i, c in enumerate(numbers)}, "said": [text], "ended": [ended]})
            return
        parts, held, last = list(parts), list(held), 0
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                last = max(last, int(r.ts.timestamp() * 1000))
                ended = ended or bool(r.is_end)
                if isinstance(r.said, str) and r.said:
                    parts.append((int(r.seq), r.said))
                for i, c in enumerate(numbers):
                    v = getattr(r, c)
                    if not pd.isna(v) and int(r.seq) >= held[2 * i + 1]:
                        held[2 * i : 2 * i + 2] = [int(v), int(r.seq)]
        state.update((parts, held, ended))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), last) + (late_ms if ended else silent_ms))

    kind = p.schema["request_id"].dataType.simpleString()
    out = f"request_id {kind}, u_input bigint, u_output bigint, input_estimate bigint, said string, ended boolean"
    g = p.groupBy("request_id").applyInPandasWithState(take, out, "parts array<struct<seq:bigint,t:string>>, held array<bigint>, ended boolean", "append", GroupStateTimeout.EventTimeTimeout)
    return g.select("request_id", F.coalesce("u_input", "input_estimate", F.lit(0)).alias("input_tokens"), F.coalesce("u_output", estimate_tokens("said")).alias("output_tokens"),
                    (F.col("u_input").isNotNull() & F.col("u_output").isNotNull()).alias("measured"), "ended")


def priced(ledger: DataFrame, prices: DataFrame) -> DataFrame:
    """Stream-static join: ledger rows with the price of their model. prices: (model, input_price, output_price)."""
    j = ledger.join(prices, "model", "left")
    uncached = F.col("input_tokens") - F.col("cached_input_tokens") * (1 - PRICE["cache_read"])
    return j.withColumn("cost", uncached * F.coalesce("input_price", F.lit(0.0)) + F.col("output_tokens") * F.coalesce("output_price", F.lit(0.0)))


def answered(requests: DataFrame, usage: DataFrame, within: str = "1 hour") -> DataFrame:
    """Stream-stream left join of requests and usage reports by id, at most ``within`` apart. A request without a report
    comes out with nulls once no report can come any more.
    requests: (request_id, ts, ...), usage: (request_id, used_ts, ...)."""
    r = requests.withWatermark("ts", LATE).alias("r")
    u = usage.withWatermark("used_ts", LATE).alias("u")
    on = (F.col("r.request_id") == F.col("u.request_id")) & (F.col("used_ts") >= F.col("ts")) & (F.col("used_ts") <= F.col("ts") + F.expr(f"INTERVAL {within}"))
    return r.join(u, on, "left").drop(F.col("u.request_id"))
