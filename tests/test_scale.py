"""The blocked paths (one group far over the limit) must equal the plain ones."""

import random
import re
import statistics

import oracle_check
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sparkmeter import scale
from sparkmeter.sources import tables


def skewed(spark, n=4000):
    """One key holds three quarters of the rows."""
    rng = random.Random(5)
    rows = [("hot" if i % 4 else f"k{i % 40}", i, rng.randrange(50), rng.choice([None, rng.randrange(9)])) for i in range(n)]
    return spark.createDataFrame(rows, "key string, ord bigint, x bigint, y bigint")


def all_ops(df):
    return scale.scan(df, ["key"], ["ord"], s=scale.running_sum(F.col("x")), e=scale.running_sum(F.col("x"), inclusive=False), i=scale.row_index(),
                      p=scale.previous(F.col("y")), n=scale.following(F.col("y")), l=scale.last_known(F.col("y")), le=scale.last_known(F.col("y"), inclusive=False),
                      f=scale.next_known(F.col("y")), m=scale.running_max(F.col("x")))


def test_blocks_bound_groups_and_keep_results(spark):
    df = skewed(spark)
    cut = scale.with_blocks(df, ["key"], "ord", min_rows=200)
    assert scale.BLOCK in cut.columns
    largest = cut.groupBy("key", scale.BLOCK).count().agg(F.max("count")).first()[0]
    assert largest < 700  # the hot key alone has 3,000 rows
    plain = {tuple(r) for r in all_ops(df).collect()}
    blocked = {tuple(r) for r in all_ops(cut).drop(scale.BLOCK).select(*all_ops(df).columns).collect()}
    assert plain == blocked


def test_small_groups_are_not_cut(spark):
    assert scale.BLOCK not in scale.with_blocks(skewed(spark), ["key"], "ord").columns


def test_exact_percentiles(spark):
    df = skewed(spark)
    got = {r["key"]: r for r in scale.exact_percentiles(df, ["key"], "x", q1=0.25, med=0.5).collect()}
    for key in ("hot", "k0"):
        xs = sorted(r["x"] for r in df.where(F.col("key") == key).collect())
        assert got[key]["med"] == statistics.median(xs)
        assert abs(got[key]["q1"] - statistics.quantiles(xs, n=4, method="inclusive")[0]) < 1e-9
    both = scale.exact_medians(df, ["key"], a="x", b="y").where("key = 'hot'").first()
    assert both["a"] == got["hot"]["med"]


def test_fold_over_blocks_equals_one_block(spark):
    rng = random.Random(3)
    rows = [(k, i, rng.randrange(-30, 60)) for k in "ab" for i in range(300)]
    df = spark.createDataFrame(rows, "key string, i bigint, d bigint")
    kind = "struct<s:bigint,resets:bigint>"
    st = lambda s, r: F.struct(s.alias("s"), r.alias("resets")).cast(kind)
    zero = F.lit(0)

    def step(s, x, p):
        nxt = s["s"] + x["d"]
        full = nxt > 200
        return st(F.when(full, 10).otherwise(nxt), s["resets"] + full.cast("bigint"))

    def run(block):
        out = scale.fold(df, ["key"], "i", F.struct("d"), [], st(zero, zero), st(zero, zero), step, lambda s: st(s["s"], zero), block)
        return {(r["key"], r["n"]) for r in out.groupBy("key").agg(F.sum("state.resets").alias("n")).collect()}

    want = set()
    for k in "ab":
        s = n = 0
        for kk, _, d in rows:
            if kk == k:
                s += d
                if s > 200:
                    s, n = 10, n + 1
        want.add((k, n))
    assert run(1000) == want
    assert run(40) == want


def test_words_of_conversations_are_ranked_in_bounded_tasks(spark, monkeypatch):
    """Rows a task grow with TURNS_PER_TASK, not with the table: no step deals (conv_id, word) out anew over a fixed number of partitions."""
    sf, name = "/root/testdata/sf0.001", "graph_edges"
    monkeypatch.setattr(tables, "TURNS_PER_TASK", 15)
    turns = spark.read.parquet(f"{sf}/conversations.parquet").count()
    tasks = -(-turns // 15)
    assert tasks > spark.sparkContext.defaultParallelism
    df = entry.queries()[name](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"hashpartitioning\((.*?), (\d+)\)", plan)
    words = [keys for keys, n in dealt if "word" in keys]
    assert not words and {int(n) for keys, n in dealt if re.fullmatch(r"conv_id#\d+L?", keys)} == {tasks}
    assert oracle_check.compare(df, oracle_check.connect(sf), entry.oracle_sql()[name]) is None
