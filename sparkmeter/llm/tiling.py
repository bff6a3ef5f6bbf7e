"""Benchmark items in documents, also with their passages in another order, by greedy string tiling.

Documents and items that share a run of SEED words are candidates. For each pair the longest runs of words common to
both and not yet marked are marked, longest first, until none of SEED words is left; runs of one length are found
with rolling Karp-Rabin hashes of both word sequences. An item is leaked when the marked words cover enough of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import save
from .words import chunks, longs, mix, words

SEED = 5
COVER = 0.5
#: Seeds of all items, 8 bytes each, that tasks may hold; beyond it seeds are joined by a shuffle.
HELD_SEEDS = 4_000_000
_BASE = np.uint64(0x100000001B3)


def _runs(h: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of n words."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(h) + 1, np.uint64)
    for i, x in enumerate(h):
        total[i + 1] = total[i] * _BASE + x
    return total[n:] - total[:-n] * np.uint64(pow(int(_BASE), n, 1 << 64))


def _first_free(free: np.ndarray, n: int) -> np.ndarray:
    """Whether each run of n words is free of marks."""
    taken = np.append(0, np.cumsum(~free))
    return taken[n:] == taken[:-n]


def tile(item: np.ndarray, doc: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """Tiles (place in item, place in doc, length), longest first; of equal ones those first in the item, then in the doc.

    The length of a round is the longest common run of unmarked words, found by halving: if runs of n match, shorter do.
    """
    free_a, free_b, tiles = np.ones(len(item), bool), np.ones(len(doc), bool), []
    rolled: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    top = min(len(item), len(doc))

    def common(n: int) -> list[tuple[int, int]]:
        if n not in rolled:
            rolled[n] = _runs(item, n), _runs(doc, n)
        a, b = rolled[n]
        at, bt = np.flatnonzero(_first_free(free_a, n)), np.flatnonzero(_first_free(free_b, n))
        bt = bt[np.isin(b[bt], a[at])]
        order = np.argsort(b[bt], kind="stable")
        keys, bt = b[bt][order], bt[order]
        at = at[np.isin(a[at], keys)]
        low, high = np.searchsorted(keys, a[at], "left"), np.searchsorted(keys, a[at], "right")
        # places of one run stand in order; a run that repeats in both is matched occurrence by occurrence below
        return [(int(i), bt[x:y]) for i, x, y in zip(at, low, high)]

    while top >= least:
        low, high = least, top
        if not common(least):
            break
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if common(mid) else (low, mid - 1)
        for i, places in common(low):
            if not free_a[i : i + low].all():
                continue
            for j in places:
                if free_b[j : j + low].all() and np.array_equal(item[i : i + low], doc[j : j + low]):
                    free_a[i : i + low] = free_b[j : j + low] = False
                    tiles.append((i, int(j), low))
                    break
        top = low
        if not tiles or tiles[-1][2] != low:  # a hash agreed but no words did
            top = low - 1
    return tiles


def _seeds(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every run of SEED words."""
    if len(h) < SEED:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    run = np.zeros(len(h) - SEED + 1, np.uint64)
    for j in range(SEED):
        run = mix(run * _BASE + h[j : len(h) - SEED + 1 + j])
    same = doc[SEED - 1 :] == doc[: len(run)]
    return run[same], doc[: len(run)][same]


def _seed_rows(name: str, held: np.ndarray | None):
    """Distinct seeds of each row, only those held if given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in chunks(batches):
            seed, owner = _seeds(*words(data, at)[:2])
            if held is not None:
                place = np.minimum(np.searchsorted(held, seed), max(len(held) - 1, 0))
                keep = held[place] == seed if len(held) else np.zeros(len(seed), bool)
                seed, owner = seed[keep], owner[keep]
            both = np.unique(np.stack([owner.astype(np.uint64), seed]), axis=1) if len(seed) else np.zeros((2, 0), np.uint64)
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(both[0].astype(np.int64))), longs(both[1])], [name, "seed"])

    return run


def _tiler(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row in b.to_pylist():
                text = (row["item_text"] or "").encode(), (row["text"] or "").encode()
                a, d = (words(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in text)
                d = _near(a, d)
                tiles = tile(a, d, least)
                covered = sum(t[2] for t in tiles)
                out.append((row["row"], row["doc_id"], row["item_id"], covered / len(a) if len(a) else 0.0, len(tiles), max((t[2] for t in tiles), default=0)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 6, (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))], ["row", "doc_id", "item_id", "coverage", "tiles", "longest"])

    return run


def _near(item: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The document's words that lie in a seed of the item; each gap between them becomes one word that nothing equals."""
    seed, _ = _seeds(item, np.zeros(len(item), np.int64))
    mine, _ = _seeds(doc, np.zeros(len(doc), np.int64))
    hit = np.flatnonzero(np.isin(mine, seed))
    keep = np.zeros(len(doc) + 1, np.int64)
    np.add.at(keep, hit, 1)
    np.add.at(keep, np.minimum(hit + SEED, len(doc)), -1)
    inside = np.cumsum(keep[:-1]) > 0
    gap = ~inside & np.append(True, inside[:-1])
    out = np.where(inside, doc, np.uint64(0))
    return out[inside | gap]


def leaks(docs: DataFrame, items: DataFrame, cover: float = COVER) -> DataFrame:
    """(row, doc_id, item_id, coverage, tiles, longest) of document rows and items with coverage of `cover` at least.

    Words are compared with A-Z as a-z. Items of fewer than SEED words can't be found; null texts have no words.
    Equal texts of documents are tiled once and told for each of their rows; `row` is the 64-bit key of the text.
    An item_id or doc_id that is null or repeated stays so in the result, one row for each pair of rows.

    Items' seeds are held by tasks while their count allows, else joined. A passage that many documents share makes
    as many candidates as there are different documents with it, each tiled on its own.
    """
    items = items.select("item_id", F.col("text").alias("item_text")).withColumn("item_key", F.xxhash64("item_text"))
    docs = docs.select("doc_id", "text").withColumn("row", F.xxhash64("text"))
    known = save(items.select("item_key", "item_text").distinct().select("item_key", F.col("item_text").alias("text")).mapInArrow(_seed_rows("item_key", None), "item_key long, seed long"), "seeds")
    distinct = known.select("seed").distinct()
    held = None
    if distinct.count() <= HELD_SEEDS:
        held = np.sort(np.array([r.seed for r in distinct.collect()], np.int64).view(np.uint64))
    seeds = docs.select("row", "text").mapInArrow(_seed_rows("row", held), "row long, seed long")
    pairs = save(seeds.join(known, "seed").groupBy("row", "item_key").agg(F.count(F.lit(1)).alias("shared")).select("row", "item_key"), "pairs")
    texts = save(docs.join(pairs.select("row").distinct(), "row", "left_semi").groupBy("row").agg(F.first("text").alias("text")), "texts")
    full = pairs.join(texts, "row").join(items.groupBy("item_key").agg(F.first("item_text").alias("item_text")), "item_key")
    full = full.select("row", F.lit(0).cast("long").alias("doc_id"), F.col("item_key").alias("item_id"), "text", "item_text")
    said = save(full.mapInArrow(_tiler(SEED), "row long, doc_id long, item_id long, coverage double, tiles long, longest long").where(F.col("coverage") >= cover).drop("doc_id").withColumnRenamed("item_id", "item_key"), "tiled")
    named = said.join(items.select("item_key", "item_id"), "item_key")
    return docs.select("doc_id", "row").join(named, "row").select("row", "doc_id", "item_id", "coverage", "tiles", "longest")


def without_leaks(docs: DataFrame, items: DataFrame, cover: float = COVER) -> DataFrame:
    """The rows of docs whose text leaks no item, with all their columns."""
    rows = save(leaks(docs, items, cover).select(F.col("row").alias("_leak")).distinct(), "leaked")
    return docs.join(rows, F.xxhash64("text") == F.col("_leak"), "left_anti")
