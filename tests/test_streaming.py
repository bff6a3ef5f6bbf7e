"""Streams replayed from files must equal their batch twins; late rows and state are bounded."""

import tempfile

from pyspark.sql import functions as F

from sparkmeter.operators import ledger
from sparkmeter.streaming import ledger_streams as ls
from sparkmeter.streaming import stateful as st

LEDGER = "ts timestamp, provider string, model string, action string, streamed bigint, measured bigint, input_tokens bigint, output_tokens bigint, " \
         "reasoning_tokens bigint, cached_input_tokens bigint, history_tokens bigint, avoided_input bigint, avoided_output bigint"


def stream_of(spark, batches, schema):
    """Each list of rows becomes one file, read one per trigger in order."""
    d = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, schema)
        df.coalesce(1).write.mode("append").parquet(f"{d}/{i:03d}")
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(d)


def run(spark, df, mode="append"):
    name = "q" + next(tempfile._get_candidate_names())
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", tempfile.mkdtemp(prefix="spark-", dir="/tmp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.sql(f"select * from {name}")


def led(t, action="forwarded", n=10):
    from datetime import datetime

    return (datetime.fromisoformat(t), "openai", "m", action, 0, 1, n, 1, 0, 0, 0, 0, 0)


def test_daily_export_equals_batch_and_drops_late_rows(spark):
    a = [led("2026-01-01 10:00:00"), led("2026-01-01 23:00:00"), led("2026-01-02 05:00:00", "cache_hit")]
    b = [led("2026-01-03 12:00:00")]
    late = [led("2026-01-01 11:00:00")]
    end = [led("2026-01-06 00:00:00")]
    got = run(spark, ls.daily_export(stream_of(spark, [a, b, late, end], LEDGER)))
    batch = ledger.daily(spark.createDataFrame(a + b, LEDGER))
    cols = ["day", "provider", "model", "action", "requests", "input_tokens"]
    assert {tuple(r) for r in got.select(cols).collect()} == {tuple(r) for r in batch.select(cols).collect()}


def test_running_totals_and_sliding_spend(spark):
    rows = [led(f"2026-01-01 10:{m:02d}:00") for m in range(0, 60, 10)]
    t = run(spark, ls.running_totals(stream_of(spark, [rows[:3], rows[3:]], LEDGER)), "complete").first()
    assert t["requests"] == 6 and t["input_tokens"] == 60
    s = run(spark, ls.sliding_spend(stream_of(spark, [rows, [led("2026-01-02 10:00:00")]], LEDGER)))
    assert s.agg(F.max("tokens")).first()[0] == 66


def test_activity_windows_and_first_usage(spark):
    from datetime import datetime, timedelta

    t0 = datetime(2026, 1, 1)
    rows = [("s", t0 + timedelta(minutes=m)) for m in (0, 10, 20, 90, 100)]
    w = run(spark, ls.activity_windows(stream_of(spark, [rows, [("x", t0 + timedelta(days=1))]], "session_id string, ts timestamp")))
    assert sorted((r["calls"], round(r["hours"], 4)) for r in w.where("session_id = 's'").collect()) == [(2, 0.1667), (3, 0.3333)]
    lines = [("s", "m1", t0), ("s", "m1", t0), ("s", "m2", t0)]
    d = run(spark, ls.first_usage(stream_of(spark, [lines, lines[:1]], "session_id string, msg_key string, ts timestamp")))
    assert d.count() == 2


READ = "session_id string, agent_id string, path string, read_range string, size bigint, mtime bigint, compactions bigint, ts timestamp, estimate bigint"


def test_guard_denies_an_unchanged_reread_once(spark):
    from datetime import datetime, timedelta

    t0 = datetime(2026, 1, 1)

    def ev(i, size=10, comp=0, rng="a", session="s"):
        return (session, "", "/f", rng, size, 1, comp, t0 + timedelta(seconds=i), 500)

    first = [ev(0), ev(1), ev(2), ev(3, rng="b")]
    second = [ev(4), ev(5, size=11), ev(6, size=11, comp=1), ev(7, session="other")]
    got = run(spark, st.reread_guard(stream_of(spark, [first, second], READ)))
    d = [(r["session_id"], r["read_range"], r["decision"]) for r in got.orderBy("ts").collect()]
    assert d == [("s", "a", "allow"), ("s", "a", "deny"), ("s", "a", "allow"), ("s", "b", "allow"), ("s", "a", "deny"), ("s", "a", "allow"), ("s", "a", "allow"), ("other", "a", "allow")]
    assert got.agg(F.sum("avoided")).first()[0] == 1000


def test_duplicate_request_stream_equals_batch(spark):
    import random
    from datetime import datetime, timedelta

    rng = random.Random(4)
    t0 = datetime(2026, 1, 1)
    rows = sorted((rng.choice("ab"), i, t0 + timedelta(seconds=rng.randrange(4000))) for i in range(60))
    rows.sort(key=lambda r: (r[2], r[1]))
    got = run(spark, st.duplicate_requests(stream_of(spark, [rows[:30], rows[30:]], "key string, request_id bigint, ts timestamp"), ttl_seconds=300, late="2 hours"))
    batch = ledger.cache_hits(spark.createDataFrame(rows, "key string, request_id bigint, ts timestamp").withColumn("at", F.unix_micros("ts") / 1e6), ttl=300.0)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in batch.collect()}


def test_churn_and_ceiling_alerts(spark):
    from datetime import datetime, timedelta

    t0 = datetime(2026, 1, 1)
    sch = "session_id string, ts timestamp, model string, context bigint, cache_read bigint, cache_write bigint, rate double, opens boolean"
    rows = [("s", t0, "m", 10_000, 0, 10_000, 1.25, True), ("s", t0 + timedelta(minutes=2), "m", 11_000, 10_000, 1_000, 1.25, False), ("s", t0 + timedelta(hours=2), "m", 12_000, 0, 12_000, 1.25, True)]
    c = run(spark, st.churn_alerts(stream_of(spark, [rows[:2], rows[2:]], sch))).collect()
    assert [(r["tokens"], r["cause"]) for r in c] == [(11_000, "gap_over_1h")]
    a = run(spark, st.ceiling_alerts(stream_of(spark, [rows[:2], rows[2:]], sch), 10_500)).collect()
    assert [r["context"] for r in a] == [11_000]


def test_joins_and_metering(spark):
    from datetime import datetime, timedelta

    t0 = datetime(2026, 1, 1)
    prices = spark.createDataFrame([("m", 2.0, 10.0)], "model string, input_price double, output_price double")
    p = run(spark, ls.priced(stream_of(spark, [[led("2026-01-01 10:00:00")]], LEDGER), prices)).first()
    assert p["cost"] == 30.0
    req = stream_of(spark, [[(1, t0), (2, t0)]], "request_id bigint, ts timestamp")
    use = stream_of(spark, [[(1, t0 + timedelta(minutes=5), 7), (2, t0 + timedelta(hours=3), 8)]], "request_id bigint, used_ts timestamp, tokens bigint")
    j = run(spark, ls.answered(req, use)).collect()
    assert [(r["request_id"], r["tokens"]) for r in j] == [(1, 7)]
    chunks = [(1, "openai", 0, 'data: {"choices":[{"delta":{"content":"hello wor"}}]}', t0), (1, "openai", 1, 'data: {"choices":[{"delta":{"content":"ld"}}]}', t0), (1, "openai", 2, "data: [DONE]", t0),
              (2, "anthropic", 0, 'data: {"type":"message_start","message":{"usage":{"input_tokens":9}}}', t0), (2, "anthropic", 1, 'data: {"type":"message_delta","usage":{"output_tokens":4}}', t0)]
    end = [(3, "openai", 0, "data: [DONE]", t0 + timedelta(hours=1))]
    m = run(spark, ls.metered(stream_of(spark, [chunks, end, end], "request_id bigint, provider string, seq int, data string, ts timestamp")))
    got = {r["request_id"]: (r["input_tokens"], r["output_tokens"], r["measured"]) for r in m.collect()}
    assert got[1] == (0, 3, False) and got[2] == (9, 4, True)


def test_reply_with_a_pause_is_one_row_and_unknown_input_is_estimated(spark):
    from datetime import datetime, timedelta

    t0 = datetime(2026, 1, 1)
    sch = "request_id bigint, provider string, seq int, data string, ts timestamp, input_estimate bigint"
    say = lambda i, seq, text, m: (i, "openai", seq, 'data: {"choices":[{"delta":{"content":"%s"}}]}' % text, t0 + timedelta(minutes=m), 100 if seq == 0 else None)
    first = [say(1, 0, "hello wor", 0), say(2, 0, "cut ", 0), say(3, 1, "b", 0)]
    second = [say(1, 1, "ld and", 9), (1, "openai", 2, "data: [DONE]", t0 + timedelta(minutes=9), None), say(3, 0, "a", 1)]  # nine minutes of silence
    tick = lambda m: [(9, "openai", 0, ": keep-alive", t0 + timedelta(minutes=m), None)]
    got = run(spark, ls.metered(stream_of(spark, [first, second, tick(60), tick(61), tick(60 * 30), tick(60 * 30 + 1)], sch)))
    rows = {r["request_id"]: (r["input_tokens"], r["output_tokens"], r["measured"], r["ended"]) for r in got.where("request_id < 9").collect()}
    assert got.where("request_id < 9").count() == 3
    assert rows == {1: (100, 4, False, True), 2: (100, 1, False, False), 3: (100, 1, False, False)}


def test_unanswered_requests_come_out_in_the_end(spark):
    from datetime import datetime, timedelta

    t0 = datetime(2026, 1, 1)
    late = t0 + timedelta(days=1)
    req = stream_of(spark, [[(1, t0), (2, t0)], [(8, late)], [(9, late + timedelta(days=1))]], "request_id bigint, ts timestamp")
    use = stream_of(spark, [[(1, t0 + timedelta(minutes=5), 7)], [(8, late, 1)], [(9, late + timedelta(days=1), 1)]], "request_id bigint, used_ts timestamp, tokens bigint")
    got = {r["request_id"]: r["tokens"] for r in run(spark, ls.answered(req, use)).collect()}
    assert got[1] == 7 and 2 in got and got[2] is None
