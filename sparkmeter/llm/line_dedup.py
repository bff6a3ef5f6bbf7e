"""Lines that are boilerplate of their site: present on more than a share of the host's pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import save

RATIO = 0.08
MIN_PAGES = 3


def _line_key(line: Column) -> Column:
    """Lines are equal when they are after leading and trailing blanks go; blank lines have no key."""
    line = F.trim(line)
    return F.when(line != "", F.md5(line))


def _free(docs: DataFrame, name: str) -> str:
    """The name, or a longer one that no column of docs has."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, pages, line_key, with_line) of lines on more than `ratio` of their host's pages and on `min_pages` at least.

    A page counts once for a line it repeats; pages without text count as pages. Null is a host of its own.
    Counts are combined before the shuffle, so a host with a third of all pages is no heavier than others.
    """
    lines = docs.select(F.col(host).alias("host"), F.explode(F.array_distinct(F.transform(F.split(text, "\n"), _line_key))).alias("line_key"))
    counts = lines.where("line_key is not null").groupBy("host", "line_key").agg(F.count(F.lit(1)).alias("with_line")).where(F.col("with_line") >= min_pages)
    pages = docs.groupBy(F.col(host).alias("of_host")).agg(F.count(F.lit(1)).alias("pages"))
    found = counts.join(pages, F.col("host").eqNullSafe(F.col("of_host"))).where(F.col("with_line") > ratio * F.col("pages"))
    return found.select("host", "pages", "line_key", "with_line")


def drop_boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """`docs` with those lines gone from the text, and line counts `_lines` and `_dropped` beside it, in place of columns so named.

    Null texts stay null with 0 lines; an empty text is one blank line; a text of which nothing is left is ''.
    Order and repeats of the other lines, and blank lines, stay. A host has at most (mean distinct lines of a
    page) / ratio such lines, so its list rides along with each of its pages; the join is broadcast only when
    the written table is below Spark's size limit, else skewed hosts are split.
    """
    found = boilerplate(docs, host, text, ratio, min_pages)
    of, drop, now = (_free(docs, n) for n in ("_host", "_drop", "_kept"))
    lists = save(found.groupBy("host").agg(F.sort_array(F.collect_list("line_key")).alias(drop)).withColumnRenamed("host", of), "boilerplate")
    rows = docs.join(lists, F.col(host).eqNullSafe(F.col(of)), "left").drop(of)
    lines = F.split(text, "\n")
    kept = F.filter(lines, lambda x: ~F.coalesce(F.array_contains(drop, _line_key(x)), F.lit(False)))
    rows = rows.withColumn(now, F.when(F.col(drop).isNull(), lines).otherwise(kept))
    rows = rows.withColumn("_lines", F.coalesce(F.size(lines), F.lit(0)).cast("long")).withColumn("_dropped", F.col("_lines") - F.coalesce(F.size(now), F.lit(0)))
    rows = rows.withColumn(text, F.when(F.col(text).isNotNull(), F.array_join(now, "\n")))
    return rows.drop(now, drop)
