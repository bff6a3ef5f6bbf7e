"""Results whose content already lies in the context: coverage of their lines by sequences seen since the compaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUN, LEAST_CHARS = 3, 12
FULL, MOSTLY = 0.95, 0.5
REMINDER, NUMBER, BLANKS = r"(?s)<system-reminder>.*?</system-reminder>", r"^ *[0-9]+(→|\t)", r"[ \t\r\f\x0B]+"


def lines(text: Column) -> Column:
    """A text's lines of at least twelve characters, without line numbers, reminders and repeated blanks."""
    clean = F.regexp_replace(F.coalesce(text, F.lit("")), REMINDER, "")
    each = F.transform(F.split(clean, "\n"), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, NUMBER, ""), BLANKS, " ")))
    return F.filter(each, lambda x: F.length(x) >= LEAST_CHARS)


def resident_duplicates(content: DataFrame) -> DataFrame:
    """One row per text: its lines and characters, those that earlier content of its epoch holds, and their class.

    content: session_id, epoch, ord (unique in an epoch), text. A line is held when it lies in three lines in a row
    that occur in an earlier text; a text of one or two lines is compared line by line. Each sequence of an epoch
    needs only the place where it is first seen, so texts are never compared in pairs: sequences that occur in one
    text only drop out before the join, and what is joined are 64-bit hashes. Texts without such lines have the class `low`.
    """
    by = ["session_id", "epoch"]
    rows = content.select(*by, "ord", lines(F.col("text")).alias("ls"))
    several = F.size("ls") >= RUN
    single = F.transform("ls", lambda x, i: F.struct(F.lit(1).alias("width"), i.alias("pos"), F.xxhash64(x).alias("h")))
    run = F.transform(F.slice("ls", F.lit(1), F.greatest(F.size("ls") - (RUN - 1), F.lit(0))), lambda x, i: F.struct(
        F.lit(RUN).alias("width"), i.alias("pos"), F.xxhash64(x, *[F.get("ls", i + j) for j in range(1, RUN)]).alias("h")))
    units = rows.select(*by, "ord", several.alias("_several"), F.inline(F.concat(single, run)))
    first = units.groupBy(*by, "width", "h").agg(F.min("ord").alias("_first"), F.max("ord").alias("_last")).where("_first < _last")
    asked = units.where(F.col("width") == F.when(F.col("_several"), RUN).otherwise(1))
    held = asked.join(first, [*by, "width", "h"]).where("ord > _first")
    held = held.groupBy(*by, "ord").agg(F.collect_set("pos").alias("_at"), F.max("width").alias("_wide"))  # as many as the text has lines
    out = rows.select(*by, "ord", F.transform("ls", lambda x: F.length(x)).alias("_chars")).join(held, [*by, "ord"], "left")
    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + x)
    spots = F.array_distinct(F.flatten(F.transform("_at", lambda i: F.sequence(i, i + F.col("_wide") - 1))))
    out = out.withColumn("_spots", F.coalesce(spots, F.array().cast("array<int>"))).select(
        *by, "ord", F.size("_chars").cast("bigint").alias("n_lines"), total("_chars").alias("chars"),
        F.size("_spots").cast("bigint").alias("held_lines"), total(F.transform("_spots", lambda i: F.get("_chars", i))).alias("held_chars"))
    share = F.col("held_chars") / F.when(F.col("chars") > 0, F.col("chars"))
    return out.withColumn("class", F.when(share >= FULL, "full").when(share >= MOSTLY, "mostly").otherwise("low"))
