from pyspark.sql import functions as F

from sparkmeter.operators import policy

WINS = "session_id string, seg_id long, kind string, birth long, end long"


def sample(spark, wins, refs, n):
    w = spark.createDataFrame(wins, WINS)
    fp = w.select("session_id").distinct().withColumn("fingerprint", F.col("session_id"))
    return [(r["session_id"], r["seg_id"], r["k"], r["stratum"]) for r in policy.validation_pairs(w, refs, fp, n).collect()]


def test_all_pairs_are_offered_once_when_few(spark):
    wins = [("a", 1, "text", 0, 5), ("a", 2, "text", 3, 4), ("b", 1, "text", 2, 9), ("b", 2, policy.PINNED, 0, 9)]
    refs = spark.createDataFrame([("a", 1, 2), ("b", 1, 8)], "session_id string, seg_id long, k long")
    every = {("a", 1, k) for k in range(1, 5)} | {("b", 1, k) for k in range(3, 9)}
    got = sample(spark, wins, refs, 100)
    hits = {("a", 1, 2), ("b", 1, 8)}
    assert len(got) == len(every) and {x[:3] for x in got if x[3] == "hit"} == hits and {x[:3] for x in got if x[3] == "miss"} == every - hits


def test_undetected_half_is_full_where_nearly_all_pairs_are_hits(spark):
    refs = spark.range(1, 1_200_001).where("id % 30000 <> 7").select(F.lit("a").alias("session_id"), F.lit(1).cast("long").alias("seg_id"), F.col("id").alias("k"))
    got = sample(spark, [("a", 1, "text", 0, 1_200_001)], refs, 60)
    missed = {x[2] for x in got if x[3] == "miss"}
    assert len(got) == 60 and len(missed) == 30 and all(k % 30000 == 7 for k in missed)
