"""Ranked lexical search: every document scored for every item by dense matrix products, exact to the last unit.

A score is a sum of integers, weight times impact. Items are dealt into blocks of bounded vocabulary; for each block
one pass over the documents keeps, of each, its length and the block's terms that it holds. Then tiles of items over
their compact vocabulary (weights) are multiplied with tiles of documents (impacts) in float64. A vocabulary tile is
so narrow that no partial sum reaches 2^53, so every product is exact; tiles are added up as 64-bit integers. A task
keeps the best documents of each item, ties by document id, and the tasks' lists are merged by a ranking window.

    weight  floor(1000 ln((2 N + 2) / (2 df + 1)))
    m       100 - 50 + (50 n N) div L
    impact  (1000000000 tf) div (1000 tf + 20 m)

N counts documents with a term, L all their terms, n those of one document, df the documents that hold a term, tf its
occurrences in the document.

A null or empty text has no terms and is never found; an item without terms finds nothing. Rows with one item_id are
one item with the terms of all their texts, and so are those without. Every row of the documents is ranked for itself,
repeated rows too; those without doc_id stand last among equal scores. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .piece_cache import piece_keys, spread
from .shared import save
from .spans import Transducer, gather, same, texts
from .words import lists, longs

TOP = 50
#: Pairs of item and term that one block may hold, in the driver and in every task, about 50 bytes each.
BLOCK_PAIRS = 1_000_000
#: Items and documents of a tile, and terms of a vocabulary tile at most; the bound of partial sums can make it narrower.
ITEM_TILE, DOC_TILE, TERM_TILE = 128, 1024, 4096
EXACT = 1 << 53
#: Over 1000 tf / (1000 tf + 20 m) with m of 50 at least.
MOST_IMPACT = 1_000_000

_TERM = np.zeros(256, np.uint8)
_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
START, END = 1, 2
#: States: outside a term, inside one. Classes: other, term, end of text.
_MACHINE = Transducer(_TERM, follow=[[0, 1, 0], [0, 1, 0]], say=[[0, START, 0], [END, 0, END]])


def _terms(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(lower-case bytes, starts, ends, row numbers) of the terms of the column text, piece by piece."""
    for data, at, rows in texts(batch, _TERM == 0):
        said, begin = _MACHINE.run(data, at)
        start, end = np.flatnonzero(said & START), np.flatnonzero(said & END)
        owner = np.searchsorted(begin, start, "right") - 1
        yield _LOWER[data], start - owner, end - owner, rows[owner]


class Vocabulary:
    """Terms found by their hash and then compared byte for byte; terms whose hashes clash stand side by side."""

    def __init__(self, terms: list[bytes]):
        size = np.array([len(t) for t in terms], np.int64)
        self.data, end = np.frombuffer(b"".join(terms), np.uint8), np.cumsum(size)
        key = piece_keys(self.data, end - size, end)
        order = np.argsort(key, kind="stable")
        self.key, self.id, self.start, self.end = key[order], order, (end - size)[order], end[order]

    def find(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Number of each span's term, or -1."""
        out = np.full(len(start), -1, np.int64)
        if not len(self.key):
            return out
        key = piece_keys(data, start, end)
        at, left = np.searchsorted(self.key, key), np.arange(len(start))
        while len(left):
            left = left[at[left] < len(self.key)]
            left = left[self.key[at[left]] == key[left]]
            place = at[left]
            hit = same(data, start[left], end[left], self.data, self.start[place], self.end[place])
            out[left[hit]] = self.id[place[hit]]
            left = left[~hit]
            at[left] += 1
        return out


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term) of the items' distinct terms, terms as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data, start, end, row in _terms(b):
                spans, first, last = gather(data, start, end)
                terms = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(np.append(first, last[-1:]).astype(np.int64)), pa.py_buffer(spans)])
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), terms.cast(pa.binary())], names=["item_id", "term"])

    return items.select(F.col("item_id").cast("long"), "text").mapInArrow(run, "item_id long, term binary").distinct()


def postings(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, n, terms, tfs): the terms that a document has, and how often which of the vocabulary; without terms, no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = max(1, len(vocabulary.key))
        for b in batches:
            if not b.num_rows:
                continue
            n, keys, counts = np.zeros(b.num_rows, np.int64), [], []
            for data, start, end, row in _terms(b):
                n += np.bincount(row, minlength=b.num_rows)
                term = vocabulary.find(data, start, end)
                key, tf = np.unique(row[term >= 0] * wide + term[term >= 0], return_counts=True)
                keys.append(key)
                counts.append(tf)
            key, where = np.unique(np.concatenate(keys), return_inverse=True)
            tf = np.bincount(where, np.concatenate(counts), len(key)).astype(np.int64)  # pieces of one text together
            row = key // wide
            each = np.bincount(row, minlength=b.num_rows)
            out = pa.RecordBatch.from_arrays([b.column(0), longs(n), lists(key % wide, each), lists(tf, each)], names=["doc_id", "n", "terms", "tfs"])
            yield out.filter(pa.array(n > 0))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, terms array<long>, tfs array<long>")


class _Best:
    """The highest scores of each item so far, equal ones by document id."""

    def __init__(self, n_items: int, top: int):
        none = np.zeros(0, np.int64)
        self.top, self.least, self.held = top, np.ones(n_items, np.int64), [(none, none, np.zeros(0, bool))] * n_items

    def add(self, item: np.ndarray, scores: np.ndarray, doc: np.ndarray, no_id: np.ndarray) -> None:
        """scores of these items by these documents. A score below an item's last place is out; one equal to it may not be."""
        floor = self.least[item]
        if scores.shape[1] > self.top:
            floor = np.maximum(floor, np.partition(scores, -self.top, axis=1)[:, -self.top])
        rows, cols = np.nonzero(scores >= floor[:, None])
        edge = np.searchsorted(rows, np.arange(len(item) + 1))
        for k, (a, b) in enumerate(zip(edge[:-1], edge[1:])):
            if b > a:
                s, d, z = self.held[item[k]]
                s, d, z = np.append(s, scores[k, cols[a:b]]), np.append(d, doc[cols[a:b]]), np.append(z, no_id[cols[a:b]])
                order = np.lexsort((d, z, -s))[: self.top]
                self.held[item[k]] = s[order], d[order], z[order]
                if len(order) == self.top:
                    self.least[item[k]] = s[order[-1]]


def _tiles(item: np.ndarray, term: np.ndarray, weight: np.ndarray) -> list[tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """(items, [(terms, weights by item and term)]): compact tiles; the sum of a tile's products stays below EXACT."""
    out = []
    for low in range(0, int(item.max()) + 1, ITEM_TILE):
        here = (item >= low) & (item < low + ITEM_TILE)
        own, cells = np.unique(term[here]), []
        items = np.arange(low, int(item[here].max()) + 1)
        width = min(TERM_TILE, (EXACT - 1) // (max(1, int(weight[own].max())) * MOST_IMPACT))
        for a in range(0, len(own), width):
            some = own[a : a + width]
            pick = here & (term >= some[0]) & (term <= some[-1])
            w = np.zeros((len(items), len(some)))
            w[item[pick] - low, np.searchsorted(some, term[pick])] = weight[term[pick]]
            cells.append((some, w))
        out.append((items, cells))
    return out


def best(rows: DataFrame, ids: list, item: np.ndarray, term: np.ndarray, weight: np.ndarray, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """(item_id, doc_id, score): of each task the best documents for each item, of `rows` as postings() has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles, found = _tiles(item, term, weight), _Best(len(ids), top)
        for whole in batches:
            for at in range(0, whole.num_rows, DOC_TILE):
                b = whole.slice(at, DOC_TILE)
                doc, no_id = b.column(0).fill_null(0).to_numpy(), b.column(0).is_null().to_numpy(zero_copy_only=False)
                n, each = b.column(1).to_numpy(), b.column(2).value_lengths().to_numpy()
                column = np.repeat(np.arange(b.num_rows), each)
                held, tf = b.column(2).flatten().to_numpy(), b.column(3).flatten().to_numpy()
                m = (100 - 50) + (50 * n * n_docs) // n_terms
                impact = (1_000_000_000 * tf) // (1000 * tf + 20 * m[column])
                order = np.argsort(held, kind="stable")
                held, column, impact = held[order], column[order], impact[order]
                for items, cells in tiles:
                    total = np.zeros((len(items), b.num_rows), np.int64)
                    for some, w in cells:
                        a, z = np.searchsorted(held, some, "left"), np.searchsorted(held, some, "right")
                        pick, dense = spread(a, z - a), np.zeros((len(some), b.num_rows))
                        dense[np.repeat(np.arange(len(some)), z - a), column[pick]] = impact[pick]
                        total += (w @ dense).astype(np.int64)
                    found.add(items, total, doc, no_id)
        each = np.array([len(s) for s, _, _ in found.held], np.int64)
        if each.sum():
            s, d, z = (np.concatenate([h[k] for h in found.held]) for k in range(3))
            owner = pa.array(ids, pa.int64()).take(pa.array(np.repeat(np.arange(len(ids)), each)))
            yield pa.RecordBatch.from_arrays([owner, pa.array(d, mask=z), pa.array(s)], names=["item_id", "doc_id", "score"])

    return rows.mapInArrow(run, "item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's `top` highest-scoring documents with a score above 0, fewer if there are fewer.

    Items go in as few blocks as their vocabulary needs (one up to BLOCK_PAIRS), each a pass over all documents. Of the documents
    only counts of the block's terms come to the driver.
    """
    pairs = save(item_terms(items), "item_terms")
    blocks = -(-pairs.count() // BLOCK_PAIRS)
    found = None
    for block in range(blocks):
        mine = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).toArrow()
        terms, ids = mine.column("term").combine_chunks().unique(), mine.column("item_id").combine_chunks().unique()
        term = pc.index_in(mine.column("term"), terms).to_numpy().astype(np.int64)
        item = pc.index_in(mine.column("item_id"), ids).to_numpy().astype(np.int64)
        rows = save(postings(docs, Vocabulary(terms.to_pylist())), "postings")
        n_docs, n_terms = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(terms), np.int64)
        counts = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).toArrow()
        df[counts.column("term").to_numpy()] = counts.column("df").to_numpy()
        weight = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
        some = best(rows, ids.to_pylist(), item, term, weight, n_docs, n_terms, top)
        found = some if found is None else found.unionByName(some)
    if found is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
