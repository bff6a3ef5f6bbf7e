"""Content digests of whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sorted_digest(lines: DataFrame, line: Column, prefix_of: Column, count: str) -> DataFrame:
    """(digest, count): SHA-256 over all lines in sorted order, and how many there are; the digest is null if there are none.

    Two levels, so that no list grows with one table: lines are hashed in sorted order per prefix of a hash of theirs
    (65,536 prefixes), then the prefixes' digests in sorted order. Repeats are one entry that tells their number, so
    a table of copies is no long list either.
    """
    d = lines.select(F.substring(prefix_of, 1, 4).alias("p"), line.alias("line")).groupBy("p", "line").agg(F.count(F.lit(1)).alias("n"))
    entry = F.when(F.col("n") > 1, F.concat("line", F.lit("\n*"), F.col("n").cast("string"))).otherwise(F.col("line"))

    def over(name):
        return F.sha2(F.array_join(F.array_sort(F.collect_list(name)), "\n"), 256)

    parts = d.withColumn("e", entry).groupBy("p").agg(over("e").alias("d"), F.sum("n").alias("n"))
    whole = parts.agg(over("d").alias("digest"), F.coalesce(F.sum("n"), F.lit(0)).alias(count))
    return whole.select(F.when(F.col(count) > 0, F.col("digest")).alias("digest"), count)
