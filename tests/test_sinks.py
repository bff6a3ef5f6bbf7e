"""Sinks that may be written again, digests of multisets, names in SQL, and the guard that sees compactions."""

import hashlib
import tempfile
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sparkmeter.functions.numbers import footprint
from sparkmeter.functions.register import register_functions
from sparkmeter.operators import labels, policy
from sparkmeter.sources import chats, sinks
from sparkmeter.streaming import stateful as st
from test_streaming import LEDGER, led, run, stream_of


def test_digest_is_of_the_multiset(spark):
    df = spark.range(500).withColumn("v", F.when(F.col("id") % 7 > 0, F.col("id")))
    one = sinks.dataset_digest(df).first()
    assert one == sinks.dataset_digest(df.repartition(7, "v").orderBy(F.desc("id"))).first() == sinks.dataset_digest(df.select("v", "id").coalesce(1)).first()
    others = [df.union(df.where("id = 3")), df.where("id <> 3"), df.withColumn("v", F.coalesce("v", F.lit(0))), df.withColumnRenamed("v", "w")]
    assert len({one.digest, *(sinks.dataset_digest(x).first().digest for x in others)}) == 5
    assert sinks.dataset_digest(df.where("false")).first().rows == 0


def test_digests_hash_every_line_in_sorted_order(spark):
    """Sums of row hashes would tell the same rows, but not withstand rows made to add up alike."""
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()

    def whole(lines, prefix):
        parts = defaultdict(list)
        for line in sorted(lines):
            parts[prefix(line)[:4]].append(line)
        return sha("\n".join(sorted(sha("\n".join(p)) for p in parts.values())))

    n = 150_000  # several lines to a prefix
    ids = spark.range(n).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("fingerprint"))
    assert policy.manifest_digest(ids).first() == (whole([f"c{i}" for i in range(n)], sha), n)
    assert sinks.dataset_digest(spark.range(n)).first() == (whole([sha('{"id":%d}' % i) for i in range(n)], str), n)


def test_ledger_batches_written_again_change_nothing(spark, tmp_path):
    path = str(tmp_path / "ledger")
    a, b = [led("2026-01-01 10:00:00"), led("2026-01-02 10:00:00")], [led("2026-01-01 10:00:00", n=7)]
    for rows, batch in ((a, 1), (b, 2), (a, 1), (b, 2)):
        sinks.append_ledger(spark.createDataFrame(rows, LEDGER), path, batch)
    assert sorted(r.input_tokens for r in sinks.read_ledger(spark, path).collect()) == [7, 10, 10]
    stream, check = str(tmp_path / "stream"), tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    source = stream_of(spark, [a, b], LEDGER)
    for _ in range(2):
        q = sinks.stream_ledger(source, stream, check)
        q.awaitTermination(60)
        assert q.exception() is None
    assert sinks.read_ledger(spark, stream).count() == 3


def test_graph_is_replaced_by_conversation(spark, tmp_path):
    path = str(tmp_path / "graph")

    def write(rows, version):
        """rows: conversation -> number of edges"""
        nodes = spark.createDataFrame([(c, f"{c}{i}", version) for c, n in rows.items() for i in range(n + 1)], "conv_id string, node_id string, version int")
        edges = spark.createDataFrame([(c, i, version) for c, n in rows.items() for i in range(n)], "conv_id string, src int, version int")
        sinks.write_graph(nodes, edges, path)

    def stored():
        n, e = (spark.read.parquet(f"{path}/{t}").groupBy("conv_id").agg(F.count("*").alias("n"), F.max("version").alias("v")).collect() for t in ("nodes", "edges"))
        return {r.conv_id: (r.n, r.v) for r in n}, {r.conv_id: (r.n, r.v) for r in e}

    write({"a": 3, "b": 1, "c": 2}, 1)
    first = stored()
    assert first == ({"a": (4, 1), "b": (2, 1), "c": (3, 1)}, {"a": (3, 1), "b": (1, 1), "c": (2, 1)})
    write({"a": 3, "b": 1, "c": 2}, 1)
    assert stored() == first
    write({"a": 0, "b": 5}, 2)  # a has no edge any more
    second = ({"a": (1, 2), "b": (6, 2), "c": (3, 1)}, {"b": (5, 2), "c": (2, 1)})
    assert stored() == second
    write({"a": 3, "b": 1, "c": 2}, 1)  # an old batch
    assert stored() == second


def test_sql_names(spark):
    register_functions(spark)
    spark.createDataFrame([("a", "User: one\nAI: two"), ("b", "AI: nobody asked"), ("c", "User: x\n\nUser: y\nAssistant: z")], "doc_id string, text string").createOrReplaceTempView("said_docs")
    got = spark.sql("SELECT doc_id, idx, role, text FROM role_marked_turns(TABLE(said_docs) PARTITION BY doc_id)").collect()
    want = chats.role_marked(spark.table("said_docs")).select("doc_id", "idx", "role", "text").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 4
    pairs = [("g", x, y) for x, y in zip("aabbbabcab", "ababbabcba")] + [("h", "a", "a")]
    df = spark.createDataFrame(pairs, "g string, a string, b string")
    df.createOrReplaceTempView("label_pairs")
    k = {r.g: r.k for r in spark.sql("SELECT g, cohen_kappa(a, b, n) AS k FROM (SELECT g, a, b, count(*) AS n FROM label_pairs GROUP BY g, a, b) GROUP BY g").collect()}
    want = {r.g: r.kappa for r in labels.kappa(df, ["g"]).collect()}
    assert k["g"] == pytest.approx(want["g"]) and k["h"] is None and want["h"] is None
    f = spark.sql("SELECT footprint(123456L) AS f").first().f.asDict()
    assert f == pytest.approx(spark.range(1).select(footprint(F.lit(123456)).alias("f")).first().f.asDict())


def test_guard_forgets_at_a_compaction(spark):
    t0 = datetime(2026, 1, 1)
    schema = "session_id string, kind string, agent_id string, path string, read_range string, size bigint, mtime bigint, ts timestamp, estimate bigint"

    def read(i, size=10, rng="a", session="s", agent=""):
        return (session, "read", agent, "/f", rng, size, 1, t0 + timedelta(seconds=i), 500)

    def compact(i, session="s"):
        return (session, "compact", None, None, None, None, None, t0 + timedelta(seconds=i), None)

    batches = [[read(0), read(1), read(2), read(3)], [read(4, rng="b"), compact(5), read(6), read(7, rng="b"), read(8)], [read(9, size=11), read(10, size=11), compact(11, "other"), read(12, size=11), read(12, agent="x"), read(13, session="other")]]
    got = run(spark, st.session_guard(stream_of(spark, batches, schema))).orderBy("ts", "agent_id").collect()
    assert [r.decision for r in got] == ["allow", "deny", "allow", "deny", "allow", "allow", "allow", "deny", "allow", "deny", "allow", "allow", "allow"]
    assert sum(r.avoided for r in got) == 4 * 500
    far = [read(0)], [read(3600 * 24 * 3, session="z")], [read(3600 * 24 * 4, session="z", rng="q")], [read(3600 * 24 * 4 + 1)]
    got = run(spark, st.session_guard(stream_of(spark, far, schema))).where("session_id = 's'").orderBy("ts").collect()
    assert [r.decision for r in got] == ["allow", "allow"]  # idle too long: the timer had forgotten it
