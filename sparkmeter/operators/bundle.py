"""Everything the analysis says about a set of transcripts, in one run and one folder."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..session import prepare
from ..sources import agent_logs as logs
from ..sources.sinks import dataset_digest
from . import bound, floor, survey, whatif

SILVER = ("index", "calls", "tool_uses", "segments")
GOLD = ("dataset", "floor", "bound", "whatif")
MANIFEST = "manifest"


def silver(raw: DataFrame, out: str) -> dict:
    """Write the tables that all analyses share; the raw lines are read once, by the first of them. Counts of that scan."""
    spark, scan = raw.sparkSession, Observation("scan")
    seen = raw.observe(scan, F.count(F.lit(1)).alias("lines"), F.sum(F.octet_length("value")).alias("bytes"))
    _put(logs.index_lines(logs.parse_lines(seen)), f"{out}/index")
    index = spark.read.parquet(f"{out}/index")
    _put(logs.calls(index), f"{out}/calls")
    _put(logs.tool_uses(index).unionByName(logs.orphan_results(index).withColumn("orphan", F.lit(True)), allowMissingColumns=True), f"{out}/tool_uses")
    _put(logs.segments(index), f"{out}/segments")
    return dict(scan.get)


def gold(spark: SparkSession, silver_path: str) -> dict[str, DataFrame]:
    """The four results, each from the silver tables alone, over sessions with calls of their own."""
    index, calls, all_uses, segs = (spark.read.parquet(f"{silver_path}/{t}") for t in SILVER)
    calls = calls.join(logs.main_chain(calls).select("session_id").distinct(), "session_id", "left_semi")
    main = logs.main_chain(calls)
    uses, orphans = all_uses.where("orphan IS NULL").drop("orphan"), all_uses.where("orphan")
    orphans = orphans.select(*[c for c in ("session_id", "use_id", "ctx_key", "is_side", "result_ord", *logs.RESULT, "has_result", "result_blk") if c in orphans.columns])
    measures = survey.measure(calls, uses, logs.instructions(index))
    sides = calls.where("ctx_key <> 'main'").groupBy("session_id").agg(F.count(F.lit(1)).alias("subagent_calls"), F.sum("context").alias("subagent_input"))
    dataset = measures.join(survey.decompose(calls, order=logs.ORDER), "session_id", "left").join(sides, "session_id", "left").fillna(0, ["subagent_calls", "subagent_input"])
    judged = floor.judged_results(uses, orphans=orphans).join(calls.select("session_id").distinct(), "session_id", "left_semi")
    floors = floor.floor(calls, judged, floor.churn(calls, logs.ORDER))
    segs = segs.join(main.select("session_id").distinct(), "session_id", "left_semi")
    scaled, _ = bound.calibrate(segs, main, order=logs.ORDER)
    wins, refs = bound.link(scaled, logs.call_terms(segs), main)
    bounds = bound.bound(bound.segment_needs(wins, refs), main)
    return dict(zip(GOLD, (dataset, floors, bounds, whatif.sweep(main, order=logs.ORDER))))


def run(raw: DataFrame, out: str, label: str = "") -> dict:
    """raw: lines as `agent_logs.read_agent_logs` gives them. Writes `out`/silver/*, `out`/gold/* and, last, `out`/manifest.

    The manifest holds the label, what the scan saw, and rows and digest of each gold table; a folder without it is
    unfinished. Its content is returned. Existing folders are an error, so runs never mix.
    """
    spark = raw.sparkSession
    prepare(spark)
    scan = silver(raw, f"{out}/silver")
    tables = {}
    for name, df in gold(spark, f"{out}/silver").items():
        _put(df, f"{out}/gold/{name}")
        d = dataset_digest(spark.read.parquet(f"{out}/gold/{name}")).first()
        tables[name] = {"rows": d.rows, "digest": d.digest}
    manifest = {"label": label, "scan": scan, "tables": tables}
    spark.range(1).select(F.lit(json.dumps(manifest, sort_keys=True)).alias("value")).coalesce(1).write.text(f"{out}/{MANIFEST}")
    return manifest


def _put(df: DataFrame, path: str) -> None:
    df.write.mode("error").parquet(path)
