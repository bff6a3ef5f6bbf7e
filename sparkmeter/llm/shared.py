"""The folder that the driver and every executor can reach, and tables written to it."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from ..scale import shared_folder

_MADE: list[str] = []


def folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the checkpoint folder that the session names; local sessions without one get a scratch folder."""
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}/{name}"
    _MADE.append(path)
    return path


def save(df: DataFrame, name: str) -> DataFrame:
    """Write once, read many times: cuts lineage, and a lost executor costs no rerun of what came before."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is run inside hands Python so many rows at once, since each holds whole texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


@atexit.register
def _forget() -> None:
    """Tables live as long as the application, since lazy results may still read them."""
    from pyarrow import fs

    for path in _MADE:
        with contextlib.suppress(Exception):
            there, at = fs.FileSystem.from_uri(path.rpartition("/")[0])
            there.delete_dir(at)
