"""Session defaults. A cluster's own settings win; these are only for local runs."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: str = "8", app: str = "sparkmeter") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # text work is heavy per byte: small shuffles stay spread over the cores
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("SPARKMETER_DRIVER_MEMORY", "12g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; fall back to a scratch folder only in local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    sc.setCheckpointDir(path)


def prepare(spark: SparkSession) -> None:
    """Settings results depend on.

    Spark 4.1 lets a union claim its children's partitioning; with adaptive execution that claim can be
    wrong and a window or aggregation over the union then skips a shuffle it needs and loses rows.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
