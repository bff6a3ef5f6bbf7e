"""Saved pages of an event API, rewritten to transcript lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import parse_time

KINDS = ("assistant", "user", "system")


def read_event_pages(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(session_id = folder, page, raw)."""
    raw = spark.read.option("wholetext", True).text(paths)
    f = F.col("_metadata.file_path")
    return raw.select(F.regexp_extract(f, r"^(.*)/[^/]+\z", 1).alias("session_id"), f.alias("page"), F.col("value").alias("raw"))


def event_lines(pages: DataFrame) -> DataFrame:
    """pages: (session_id, page, raw) -> raw lines (session_id, at, rank, pos, value).

    A page is an object, or a list of text blocks that hold one. An event seen on several pages counts
    once: its last version, at its time; events without a readable time come last.
    """
    lenient = {"allowUnquotedControlChars": "true"}
    wrapped = F.from_json("raw", "array<struct<text:string>>", lenient)
    inside = F.transform(F.filter(wrapped, lambda b: b["text"].isNotNull()), lambda b: b["text"])
    texts = F.coalesce(F.when(F.trim("raw").startswith("["), inside), F.array("raw"))
    one = pages.select("session_id", "page", F.posexplode(texts).alias("part", "t"))
    body = F.when(F.trim("t").startswith("{"), F.col("t")).otherwise(F.substring("t", F.greatest(F.locate('{"ccr"', "t"), F.lit(1)), F.lit(2_000_000_000)))
    events = F.from_json(body, "ccr struct<data:array<variant>>", lenient)["ccr"]["data"]
    e = one.select("session_id", "page", "part", F.posexplode(events).alias("i", "e"))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.try_variant_get("e", f"$.{k}", "variant").alias("x")) for k in KINDS])
    e = e.select("session_id", "page", "part", "i", F.try_variant_get("e", "$.created_at", "string").alias("created"), F.inline(kinds)).where("x IS NOT NULL")
    s = lambda p: F.try_variant_get("x", p, "string")
    uid = F.coalesce(s("$.uuid"), F.concat_ws("-", "created", "kind", "page", "part", "i"))
    stamp = F.coalesce(s("$.timestamp"), F.col("created"))
    parent = s("$.parent_tool_use_id")
    flag = lambda *ps: F.coalesce(*[F.try_variant_get("x", p, "boolean") for p in ps], F.lit(False))
    line = F.to_json(F.struct(
        F.col("kind").alias("type"), F.try_variant_get("x", "$.message", "variant").alias("message"), stamp.alias("timestamp"), (F.coalesce(parent, F.lit("")) != "").alias("isSidechain"),
        parent.alias("agentId"), s("$.subtype").alias("subtype"), flag("$.isMeta", "$.isSynthetic").alias("isMeta"), flag("$.isCompactSummary").alias("isCompactSummary"), s("$.request_id").alias("requestId")))
    place = F.struct("page", "part", "i")
    u = e.select("session_id", uid.alias("uid"), place.alias("place"), stamp.alias("ts"), line.alias("value")) \
        .groupBy("session_id", "uid").agg(F.max_by(F.struct("ts", "value"), "place").alias("last"), F.min("place").alias("first"))
    at = F.coalesce(F.unix_micros(parse_time("last.ts")), F.lit(2**62))
    # ties: raw time text, then first appearance; both are folded into one order value per instant
    u = u.select("session_id", at.alias("at"), F.struct(F.col("last.ts").alias("ts"), "first").alias("tie"), F.col("last.value").alias("value"))
    from ..scale import row_index, scan

    u = scan(u, ["session_id", "at"], ["tie"], pos=row_index())
    return u.select("session_id", "at", F.lit(0).cast("bigint").alias("rank"), "pos", "value")
