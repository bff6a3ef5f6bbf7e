"""Gold tables, numbers only, with content digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.digests import sorted_digest
from ..scale import materialize


def write_dataset(measures: DataFrame, path: str, subject: str) -> None:
    measures.withColumn("subject", F.lit(subject)).write.mode("overwrite").partitionBy("subject").parquet(path)


def dataset_digest(rows: DataFrame) -> DataFrame:
    """One digest of a table's content, whatever its order or partitioning: rows as JSON with columns in name order."""
    h = F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}), 256)
    return sorted_digest(rows, h, h, "rows")


def write_statements(statements: DataFrame, path: str, order: list[str]) -> None:
    """Text files in global order; range partitions, so no single task holds everything."""
    statements.repartitionByRange(*order).sortWithinPartitions(*order).select("statement").write.mode("overwrite").text(path)


def append_ledger(ledger: DataFrame, path: str, batch: str) -> None:
    """Rows under their day and the batch that brought them. Writing a batch again replaces it, so a replay changes nothing."""
    rows = ledger.withColumns({"day": F.to_date("ts"), "batch": F.lit(str(batch))})
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(path)


def stream_ledger(ledger: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """A stream of ledger rows into `append_ledger`, each micro-batch under its own number: exactly once, also over restarts."""
    return ledger.writeStream.foreachBatch(lambda df, i: append_ledger(df, path, f"stream-{i}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replace_rows(rows: DataFrame, path: str, keys: list[str], version: str, changed: DataFrame | None = None, buckets: int = 64) -> None:
    """Upsert by key into a table of key buckets: of each key all rows of its highest version stay, and no others.

    The highest version of each key is kept beside the rows, so a key without rows is remembered too.
    A key may have many rows (the edges of a conversation), which are replaced together; one that is in `changed`
    (keys, version) without rows loses what it had. Only buckets that hold a changed key are read and written again.
    Of one version the later write counts, so a replay changes nothing; an older version changes nothing either.
    `buckets` belongs to the table: use one number for all its writes.
    """
    spark, known = rows.sparkSession, f"{path}/_keys"  # readers pass over names that begin so
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("bucket")
    changed = (rows if changed is None else changed).groupBy(*keys).agg(F.max(version).alias("_new")).select("*", bucket)
    if _exists(spark, known):
        seen = spark.read.parquet(known).join(changed.select("bucket").distinct(), "bucket").select(*keys, "bucket", "_new")
        old = seen.select(*keys, F.col("_new").alias("_old"))
        changed = changed.join(old, keys, "left").where("_old IS NULL OR _old <= _new").drop("_old")
        changed = materialize(changed)
        versions = changed.unionByName(seen.join(changed.select(*keys), keys, "left_anti"))
    else:
        changed = versions = materialize(changed)
    rows = rows.join(changed, keys).where(F.col(version) == F.col("_new")).drop("_new")
    if _exists(spark, f"{path}/bucket=*"):
        stored = spark.read.parquet(path).join(changed.select("bucket").distinct(), "bucket")
        rows = rows.unionByName(stored.join(changed.select(*keys), keys, "left_anti"))
    rows = materialize(rows)  # written only after all that it replaces has been read
    # the versions first: should the rows' write fail, an older batch is refused and this one may come again
    for what, where in ((materialize(versions), known), (rows, path)):
        what.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(where)
    _clear_empty(rows, changed, path)


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether anything matches the path, which may hold a pattern."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p))


def _clear_empty(rows: DataFrame, changed: DataFrame, path: str) -> None:
    """Dynamic overwrite leaves a bucket alone that has no rows any more; at most `buckets` names come to the driver."""
    spark = rows.sparkSession
    for r in changed.select("bucket").distinct().join(rows.select("bucket").distinct(), "bucket", "left_anti").collect():
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={r.bucket}")
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, version: str = "version") -> None:
    """Conversations' nodes (conv_id, node_id, ...) and edges (conv_id, ...), replaced conversation by conversation."""
    convs = nodes.select("conv_id", version).distinct()
    replace_rows(nodes, f"{path}/nodes", ["conv_id"], version, convs)
    replace_rows(edges, f"{path}/edges", ["conv_id"], version, convs)


def read_ledger(spark, path: str, since=None) -> DataFrame:
    """since (a date) prunes day partitions."""
    led = spark.read.parquet(path)
    return led if since is None else led.where(F.col("day") >= F.lit(since))


def read_index(spark, path: str) -> DataFrame:
    """Curated CSV with its exact header and line numbers; a different header is an error."""
    from ..operators.bench import INDEX_COLUMNS

    schema = ", ".join(f"{c} string" for c in INDEX_COLUMNS)
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("multiLine", True).csv(path)
    return df.withColumn("line", F.monotonically_increasing_id() + 2)


def read_contributions(spark, path: str) -> DataFrame:
    """Stored records {id, payload, verified}; payload kept as JSON text for validation."""
    return spark.read.schema("id string, payload string, verified boolean").json(path)


def read_bench_results(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, unreadable files)."""
    schema = """schema string, harness_version string, taskset string, model string, settings string, summary string,
        rows array<struct<id:string,correct:boolean,completion_tokens:bigint,reasoning_tokens:bigint,min_tokens:bigint,measured:boolean>>, _corrupt string"""
    raw = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    raw = raw.select(F.col("_metadata.file_path").alias("result"), "*")
    bad = raw.where("_corrupt IS NOT NULL").select("result", F.lit("unreadable").alias("error"))
    return raw.where("_corrupt IS NULL").select("result", "model", "settings", "taskset", F.inline("rows")), bad
