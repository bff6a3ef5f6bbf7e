"""Document fingerprints by winnowing, with DataFrame functions only.

A text's k-grams of code points are hashed; of every `window` consecutive hashes the smallest is chosen, the
rightmost of equal ones, and kept with its position. Two texts that share `window + k - 1` code points in a row
therefore share a fingerprint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import prepare

GRAM, WINDOW = 16, 16
#: Hash and position share one long, so that one minimum finds the smallest hash and, of equal ones, the rightmost:
#: below the hash stands how far a gram's first byte, at four bytes a code point, is from the end of the longest text.
PLACE_BITS = 31
LAST = (1 << PLACE_BITS) - 1
BUCKET_BITS = 8
BLOCK = 96
#: Stands for a window beyond a text's end; no packed gram has all its low bits set.
NO_WINDOW = (1 << 63) - 1


def _let(value: Column, use) -> Column:
    """`use(value)` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _minima(text: Column, k: int, window: int) -> Column:
    """For each window of grams, from the left, its chosen gram as a packed long; the text is not empty."""

    def grams(code: Column) -> Column:
        last = F.greatest(F.octet_length(code) - 4 * k, F.lit(0))
        places = F.sequence(F.lit(LAST - 1), F.lit(LAST - 1) - last, F.lit(-4))
        return F.transform(places, lambda v: F.shiftleft(F.xxhash64(F.substring(code, F.lit(LAST) - v, F.lit(4 * k))), PLACE_BITS).bitwiseOR(v.cast("long")))

    def least(g: Column) -> Column:
        steps = F.array(*(F.lit(4**i) for i in range(len(bin(window)) // 2 - 1)))
        low = F.aggregate(steps, g, lambda a, s: F.transform(a, lambda x, i: F.least(x, F.get(a, i + s), F.get(a, i + 2 * s), F.get(a, i + 3 * s)))) if window > 1 else g
        return F.slice(low, F.lit(1), F.greatest(F.size(g) - window + 1, F.lit(1)))

    return _let(_let(F.encode(text, "UTF-32"), grams), least)


def _none() -> Column:
    return F.array().cast("array<bigint>")


def winnow(text: Column, k: int = GRAM, window: int = WINDOW) -> Column:
    """Chosen (hash, position) pairs, packed as array<bigint>; `hashes` and `positions` unpack them.

    Null and empty texts have none. A text shorter than k is one gram; fewer grams than a window are one window.
    The window must be a power of four.
    """
    _checked(window)
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, _none()).otherwise(F.array_distinct(_minima(text, k, window)))


def winnow_blocks(rows: DataFrame, keys: list[str], texts: dict[str, Column], about: Column, k: int = GRAM, window: int = WINDOW) -> DataFrame:
    """`keys, about` and, named as in `texts`, the chosen grams of each text, smallest first; the same as `winnow` finds.

    A text is cut into blocks of BLOCK windows, and each block's hashes and minima are plain columns, which compiled
    code computes many times faster than a function over array elements. More than a hundred columns also keep Spark
    from putting them into one method that is too long for the JVM to compile. keys name a row, and rows must be
    clustered by the first of them; then bringing blocks together again needs no shuffle. `about` is any struct of
    the row.
    """
    of = F.explode(F.array(*(F.struct(F.lit(i).alias("t"), F.encode(F.coalesce(x, F.lit("")), "UTF-32").alias("code")) for i, x in enumerate(texts.values()))))
    rows = rows.select(*keys, about.alias("_about"), of.alias("_of")).select(*keys, "_about", F.col("_of.t").alias("_t"), F.col("_of.code").alias("_code"))
    size = (F.octet_length("_code") / 4).cast("int")
    grams = F.when(size == 0, F.lit(0)).otherwise(F.greatest(size - k + 1, F.lit(1)))
    rows = rows.withColumn("_grams", grams).withColumn("_first", F.explode(F.sequence(F.lit(0), F.greatest(F.col("_grams") - window, F.lit(0)), F.lit(BLOCK))))
    head = (F.col("_first") == 0) & (F.col("_t") == 0)
    rows = rows.select(*keys, F.when(head, F.col("_about")).alias("_about"), "_t", "_grams", "_first", F.substring("_code", F.col("_first") * 4 + 1, F.lit(4 * (BLOCK + window + k))).alias("_block"))
    place = F.lit(LAST - 1) - F.col("_first") * 4
    gram = lambda i: F.when(F.col("_first") + i < F.col("_grams"), F.shiftleft(F.xxhash64(F.substring("_block", F.lit(4 * i + 1), F.lit(4 * k))), PLACE_BITS).bitwiseOR((place - 4 * i).cast("long")))
    rows = rows.select(*keys, "_about", "_t", "_grams", "_first", *(gram(i).alias(f"_h{i}") for i in range(BLOCK + window - 1)))
    # an empty text's only window has no gram
    least = lambda s: F.when((F.col("_grams") > 0) & (F.col("_first") + s <= F.greatest(F.col("_grams") - window, F.lit(0))), F.least(*(f"_h{i}" for i in range(s, s + window))) if window > 1 else F.col(f"_h{s}")).otherwise(NO_WINDOW)
    rows = rows.select(*keys, "_about", "_t", F.array_distinct(F.array(*(least(s) for s in range(BLOCK)))).alias("_low"))
    every = lambda i: F.sort_array(F.array_remove(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("_t") == i, F.col("_low"))))), NO_WINDOW))
    return rows.groupBy(*keys).agg(F.first("_about", ignorenulls=True).alias("_about"), *(every(i).alias(name) for i, name in enumerate(texts))).select(*keys, "_about.*", *texts)


def _checked(window: int) -> None:
    if window < 1 or window & (window - 1) or not window.bit_length() % 2:
        raise ValueError("the window must be a power of four")


def hashes(packed: Column) -> Column:
    return F.array_distinct(F.transform(packed, lambda x: F.shiftright(x, PLACE_BITS)))


def positions(packed: Column) -> Column:
    """0-based code point positions, in the order of `packed`."""
    return F.transform(packed, lambda x: F.shiftright(F.lit(LAST - 1) - x.bitwiseAND(F.lit(LAST)), 2).cast("int"))


def digest(packed: Column) -> Column:
    """128 bits over the chosen hashes and positions as a hex string."""
    return F.lower(F.concat(F.lpad(F.hex(F.xxhash64(packed)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit("2"), packed)), 16, "0")))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two hash sets; two empty sets are alike, an empty and a full one are not."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(shared / (F.size(a) + F.size(b) - shared))


def fingerprints(docs: DataFrame, text: str = "text", k: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Adds fp_hashes and fp_positions; other columns stay."""
    return docs.withColumn("_fp", winnow(F.col(text), k, window)).withColumns({"fp_hashes": F.transform("_fp", lambda x: F.shiftright(x, PLACE_BITS)), "fp_positions": positions(F.col("_fp"))}).drop("_fp")


def with_following(docs: DataFrame, key: str, cols: list[str]) -> tuple[DataFrame, Window]:
    """Rows dealt by ranges of the key, each range followed by a copy (`_copy` = 1) of the row that comes after it.

    So `lead` over the returned window sees each row's successor in the order of the key (nulls first, ties by
    the columns), the last row's being the first, and no window holds more than one range. Ranges are
    2**BUCKET_BITS key values wide; the order of ranges is found from their numbers alone.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.shiftright(F.coalesce(F.col(key), F.lit(-(2**63))), BUCKET_BITS).alias("_bucket"), F.lit(0).alias("_copy"), F.coalesce(F.col(key), F.lit(-(2**63))).alias("_key"), key, *cols)
    row = F.struct("_key", key, *cols)
    first = rows.groupBy("_bucket").agg(F.min_by(row, F.struct("_key", *cols)).alias("_row"))
    bucket = rows.select("_bucket").distinct().withColumn("_far", F.shiftright("_bucket", 16))
    far = bucket.groupBy("_far").agg(F.min("_bucket").alias("_head"))  # one row for 2**24 key values
    order = Window.orderBy("_far")
    far = far.select("_far", F.coalesce(F.lead("_head").over(order), F.first("_head").over(order)).alias("_next_head"))
    near = Window.partitionBy("_far").orderBy("_bucket")
    after = bucket.withColumn("_next", F.lead("_bucket").over(near)).join(far, "_far").select("_bucket", F.coalesce("_next", "_next_head").alias("_next"))
    copies = after.join(first.withColumnRenamed("_bucket", "_next"), "_next").select("_bucket", F.lit(1).alias("_copy"), "_row.*")
    return rows.unionByName(copies), Window.partitionBy("_bucket").orderBy("_copy", "_key", *cols)


def edited_fingerprints(docs: DataFrame, k: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last floor(n/2) code points are the next text's first.

    (doc_id, n_chars, edited_sha256, fp, edited_fp, next_fp) with packed fingerprints. Null texts are empty. Rows without
    doc_id come first; rows of one doc_id follow each other by text. A single row is its own next one.
    """
    rows, order = with_following(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id", ["text"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("_more", F.coalesce(F.substring(F.lead("text").over(order), F.lit(1), half), F.lit(""))).withColumn("_row", F.row_number().over(order))
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), "_more"))
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("edited_sha256", F.sha2("edited", 256))
    about = F.struct("_copy", "doc_id", "n_chars", "edited_sha256")
    rows = winnow_blocks(rows, ["_bucket", "_row"], {"fp": F.col("text"), "edited_fp": F.col("edited")}, about, k, window)
    rows = rows.withColumn("next_fp", F.lead("fp").over(Window.partitionBy("_bucket").orderBy("_row"))).where("_copy = 0")
    return rows.select("doc_id", "n_chars", "edited_sha256", "fp", "edited_fp", "next_fp")
