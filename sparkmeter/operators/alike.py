"""Pairs of prompts that are nearly the same, found by signatures that similar ones always share."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..llm.ngram_join import signatures
from ..llm.shared import save
from ..llm.words import longs, mix

SKETCH, FOLDED = 8, 2  # longs of parity bits, and of the same folded for a first look
WORDS_AT_ONCE = 500_000
TILE = 128  # members of a family that meet in one task, about
BLOCKS = 8  # of a fingerprint's 64 bits; two of them are equal if at most six bits differ


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, words, the row of each, words by row) of few enough rows at a time; `words` is the last column."""
    for batch in batches:
        ends = np.append(0, np.cumsum(pc.list_value_length(batch.column(batch.num_columns - 1)).to_numpy(zero_copy_only=False)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + WORDS_AT_ONCE, "right")) - 1)
            rows = batch.slice(at, to - at)
            sizes = np.diff(ends[at:to + 1]).astype(np.int64)
            h = rows.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            yield rows, h, np.repeat(np.arange(len(sizes)), sizes), sizes
            at = to


def _signed(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, h, owner, sizes in _slices(batches):
            sig, n = signatures(h, owner, sizes, num, den)
            group, node = (rows.column(c).to_numpy().view(np.uint64) for c in (0, 1))
            yield pa.RecordBatch.from_arrays([longs(mix(sig ^ np.repeat(group, n))), longs(np.repeat(node, n))], ["sig", "node"])

    return run


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, h, owner, sizes in _slices(batches):
        bits = np.zeros((len(sizes), SKETCH), np.uint64)
        bit = mix(h + np.uint64(77)) % np.uint64(64 * SKETCH)
        np.bitwise_xor.at(bits, (owner, (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
        yield pa.RecordBatch.from_arrays([rows.column(0), longs(sizes), *map(longs, bits.T.copy())], ["node", "m", *(f"p{i}" for i in range(SKETCH))])


def pairs_by_words(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b), a < b: nodes of one group whose word sets have a Jaccard similarity of num / den at least.

    sets: (group, node, words), all longs, words an array of distinct hashes; a node may have several equal rows.
    Every set gives PartEnum signatures, about three for four words, each of some six words, so unlike sets rarely
    share one. A pair that does is looked at by parity bits, which never rule out a similar one, then by the words.
    """
    sets = sets.where("size(words) > 0").select("group", "node", "words")
    rows = sets.mapInArrow(_signed(num, den), "sig long, node long").repartition("sig").distinct()
    about = sets.select("node", "words").mapInArrow(_sketched, "node long, m long, " + ", ".join(f"p{i} long" for i in range(SKETCH)))
    about = save(about.dropDuplicates(["node"]), "sketches")

    def could(odd: Column) -> Column:
        """Never false of a similar pair: sets differ in at least as many words as their parity bits differ."""
        small, large = F.least("x.m", "y.m"), F.greatest("x.m", "y.m")
        return (small * den >= large * num) & ((den - num) * (small + large) >= (den + num) * odd)

    differ = lambda c: F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}")))
    half = SKETCH // FOLDED
    folded = [functools.reduce(Column.bitwiseXOR, [F.col(f"p{i + j * FOLDED}") for j in range(half)]).alias(f"q{i}") for i in range(FOLDED)]
    met = save(in_company(rows), "met").join(about.select("node", F.col("m").cast("int").alias("m"), *folded), "node")  # a few bits tell most sets apart
    cand = met.alias("x").join(met.alias("y"), (F.col("x.sig") == F.col("y.sig")) & (F.col("x.node") < F.col("y.node")) & could(sum((differ(f"q{i}") for i in range(FOLDED)), F.lit(0))))
    cand = save(cand.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct(), "met_pairs")
    x, y = about.alias("x"), about.alias("y")
    cand = cand.join(x, F.col("a") == F.col("x.node")).join(y, F.col("b") == F.col("y.node"))
    cand = save(cand.where(could(sum((differ(f"p{i}") for i in range(SKETCH)), F.lit(0)))).select("a", "b"), "looked_at")
    # copies of copies are pairs of the same few sets: a family's sets go to a task once, or once for each tile of a large family
    first = cand.groupBy(F.col("b").alias("a")).agg(F.min("a").alias("_f"))
    tiled = cand.join(first, "a", "left").withColumn("family", F.coalesce("_f", "a"))
    parts = tiled.groupBy("family").agg(F.ceil(F.approx_count_distinct("b") / TILE).cast("int").alias("n"))
    cut = lambda c: F.pmod(F.xxhash64(c), F.col("n"))
    tiled = save(tiled.join(parts, "family").select(F.xxhash64("family", F.least(cut("a"), cut("b")), F.greatest(cut("a"), cut("b"))).alias("tile"), "a", "b"), "tiled")
    held = tiled.select("tile", F.explode(F.array("a", "b")).alias("node")).distinct()
    words = sets.select("node", "words").join(held.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])
    words = held.join(words, "node").select(F.col("tile").alias("place"), "node", "words")
    return tiled.groupBy("tile").cogroup(words.groupBy("place")).applyInArrow(_verified(num, den), "a long, b long")


def _verified(num: int, den: int):
    """The similar ones of a tile's pairs, by its word sets."""

    def run(pairs: pa.Table, words: pa.Table) -> pa.Table:
        held = {n: i for i, n in enumerate(words.column("node").to_pylist())}
        lists = words.column("words").combine_chunks()
        sets = [np.sort(lists[i].values.to_numpy(zero_copy_only=False)) for i in range(len(held))]
        similar = []
        for a, b in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist()):
            v, w = sets[held[a]], sets[held[b]]
            common = len(np.intersect1d(v, w, assume_unique=True))
            similar.append(den * common >= num * (len(v) + len(w) - common))
        return pairs.select(["a", "b"]).filter(pa.array(similar, pa.bool_()))

    return run


def in_company(rows: DataFrame) -> DataFrame:
    """Rows (sig, node) whose signature another node has too."""
    from pyspark.sql import Window

    by = Window.partitionBy("sig")
    return rows.withColumns({"_lo": F.min("node").over(by), "_hi": F.max("node").over(by)}).where("_lo <> _hi").select("sig", "node")


def pairs_by_bits(prints: DataFrame, most: int = BLOCKS - 2) -> DataFrame:
    """(a, b), a < b: nodes of one group whose 64-bit fingerprints differ in at most `most` bits, none of them 0.

    prints: (group, node, fp), one row per node. Of eight blocks of eight bits two are equal in such a pair, so it shares one of
    28 signatures of sixteen bits.
    """
    if most > BLOCKS - 2:
        raise ValueError(f"at most {BLOCKS - 2} bits, or blocks in pairs would miss some")
    block = lambda i: F.shiftrightunsigned("fp", 8 * i).bitwiseAND(F.lit(255))
    keys = F.array(*[F.lit(n << 16) + block(i) * 256 + block(j) for n, (i, j) in enumerate(combinations(range(BLOCKS), 2))])
    rows = prints.where("fp <> 0").select("group", "node", "fp", F.explode(keys).alias("key"))
    x, y = rows.alias("x"), rows.alias("y")
    near = x.join(y, (F.col("x.group") == F.col("y.group")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & _near("x.fp", "y.fp", most))
    return near.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def _near(a: str, b: str, most: int) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= most
