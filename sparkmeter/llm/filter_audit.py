"""What each of five text filters removes, alone and after others, in every order.

One pass of a finite-state transducer over the UTF-8 bytes finds word edges, capitals, code points and symbols; the
words' spans go into a hash table that compares bytes, so distinct words are counted exactly. Of a document only its
counts and a digest are shuffled. Documents that fail the same filters are alike to every order, so a part of the
corpus is described by 32 counts, from which all orders follow.

    A  fewer than 50 words            D  holds one of # $ % & * |
    B  under 65 % distinct words      E  a text that a smaller doc_id has too
    C  over 5 % capitals A-Z

A null text is empty (0 words: fails A), a null source is the part '', a document without a label is neither good nor
toxic, repeated labels count once and 1 wins. A null doc_id is smaller than none and greater than none, so E spares it;
rows that repeat the smallest doc_id of a text are spared as well. No documents, no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spans import Transducer, distinct, gather, texts

LETTERS = "ABCDE"
MIN_WORDS, DISTINCT_SHARE, CAPITAL_SHARE = 50, 65, 5
START, END, CAPITAL, POINT, SYMBOL = 1, 2, 4, 8, 16

_BLANK, _PLAIN, _UPPER, _MARK, _MORE, _TEXT_END = range(6)
_CLASS = np.full(256, _PLAIN, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = _BLANK
_CLASS[0x41:0x5B] = _UPPER
_CLASS[list(b"#$%&*|")] = _MARK
_CLASS[0x80:0xC0] = _MORE  # bytes within a code point
#: States: outside a word, inside one. Classes: blank, plain, capital, symbol, within a code point, end of text.
_MACHINE = Transducer(
    _CLASS,
    follow=[[0, 1, 1, 1, 1, 0], [0, 1, 1, 1, 1, 0]],
    say=[
        [POINT, START | POINT, START | POINT | CAPITAL, START | POINT | SYMBOL, START, 0],
        [END | POINT, POINT, POINT | CAPITAL, POINT | SYMBOL, 0, END],
    ],
)
_MEASURED = "doc_id long, part string, digest binary, n_words long, n_distinct long, n_capitals long, n_points long, n_symbols long"


def _counts(batch: pa.RecordBatch) -> np.ndarray:
    """Words, distinct words, capitals, code points and symbols of each row's text."""
    out = np.zeros((batch.num_rows, 5), np.int64)
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for data, at, rows in texts(batch, _CLASS == _BLANK):
        said, begin = _MACHINE.run(data, at)
        for k, bit in ((0, START), (2, CAPITAL), (3, POINT), (4, SYMBOL)):
            out[rows, k] += np.add.reduceat((said & bit) > 0, begin, dtype=np.int64)
        start, end = np.flatnonzero(said & START), np.flatnonzero(said & END)
        owner = np.searchsorted(begin, start, "right") - 1
        start, end = start - owner, end - owner  # places in the bytes: one step a text is no byte
        new = distinct(data, start, end, owner)
        if len(rows) == 1:  # perhaps one of several pieces
            spans = gather(data, start[new], end[new])
            held.setdefault(int(rows[0]), []).append((spans[0], spans[2] - spans[1]))
        else:
            out[rows, 1] += np.bincount(owner[new], minlength=len(rows))
    for row, parts in held.items():
        data, size = (np.concatenate(x) for x in zip(*parts))
        end = np.cumsum(size)
        out[row, 1] = len(size) if len(parts) == 1 else len(distinct(data, end - size, end, np.zeros(len(size), np.int64)))
    return out


def measure(docs: DataFrame, part: str = "source") -> DataFrame:
    """(doc_id, part, digest, n_words, n_distinct, n_capitals, n_points, n_symbols): what the filters look at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                counts = _counts(b)
                digest = [hashlib.sha256((x.as_py() or "").encode("utf-8", "surrogatepass")).digest() for x in b.column(2)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(digest, pa.binary()), *(pa.array(counts[:, k].copy()) for k in range(5))], names=_MEASURED.replace(",", "").split()[::2])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part), F.lit("")).alias("part"), F.col("text"))
    return narrow.mapInArrow(run, _MEASURED)


def _bit(letter: str) -> int:
    return 1 << LETTERS.index(letter)


def own_failures(m: DataFrame) -> Column:
    """Bits of the filters that judge a document by itself, A to D."""
    tests = {
        "A": m.n_words < MIN_WORDS,
        "B": 100 * m.n_distinct < DISTINCT_SHARE * m.n_words,
        "C": 100 * m.n_capitals > CAPITAL_SHARE * m.n_points,
        "D": m.n_symbols > 0,
    }
    return sum((F.when(test, _bit(k)).otherwise(0) for k, test in tests.items()), F.lit(0))


def histogram(measured: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by the set of filters that they fail.

    Equal texts meet as one row a part and label, combined before the shuffle, so a text that a third of all
    documents have is no heavier than another. Each of these rows keeps its smallest id and how often that occurs.
    """
    rows = measured.select("doc_id", "part", "digest", own_failures(measured).alias("own")).groupBy("doc_id", "part", "digest", "own").agg(F.count(F.lit(1)).alias("n"))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    rows = rows.join(known, "doc_id", "left").fillna(False, ["good", "toxic"])
    alike = rows.groupBy("digest", "part", "own", "good", "toxic").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least"),
    )
    first = F.min("least.doc_id").over(Window.partitionBy("digest"))
    spared = F.col("unnamed") + F.when(F.col("least.doc_id") == F.col("first_id"), F.col("least.n")).otherwise(0)
    two = F.explode(F.array(F.struct(F.col("own").alias("mask"), spared.alias("n")), F.struct((F.col("own") + _bit("E")).alias("mask"), (F.col("n") - spared).alias("n"))))
    each = alike.withColumn("first_id", first).select("part", "good", "toxic", two.alias("x")).select("part", "good", "toxic", "x.*").where("n > 0")
    count = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c)
    return each.groupBy("part", "mask").agg(F.sum("n").alias("n"), count("good"), count("toxic"))


def _steps() -> str:
    """Every step of every order: its filter, and those applied before it."""
    return json.dumps([
        {"filter_order": "".join(order), "step": k + 1, "bit": _bit(order[k]), "before": sum(map(_bit, order[:k]))}
        for order in itertools.permutations(LETTERS) for k in range(len(LETTERS))
    ])


def orders(counts: DataFrame) -> DataFrame:
    """The audit of each part in all orders, from its histogram: a sum over 32 masks at most for each step."""
    packed = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    steps = F.from_json(F.lit(_steps()), "array<struct<filter_order string, step int, bit int, before int>>")
    rows = packed.select("part", "masks", F.explode(steps).alias("s")).select("part", "masks", "s.*")

    def total(when, what=lambda m: m.n) -> Column:
        return F.aggregate("masks", F.lit(0).cast("long"), lambda a, m: a + F.when(when(m.mask), what(m)).otherwise(F.lit(0)).cast("long"))

    fails = lambda m: m.bitwiseAND(F.col("bit")) != 0
    earlier = lambda m: m.bitwiseAND(F.col("before")) != 0
    removed = lambda m: fails(m) & ~earlier(m)
    n_orders = len(list(itertools.permutations(LETTERS)))
    return rows.select(
        "part", "filter_order", "step",
        total(lambda m: ~fails(m) & ~earlier(m)).alias("kept"), total(removed).alias("removed"), total(lambda m: fails(m) & earlier(m)).alias("redundant"),
        total(lambda m: m == F.col("bit")).alias("unique_fails"), total(removed, lambda m: m.good).alias("good_lost"), total(removed, lambda m: m.toxic).alias("toxic_lost"),
        # each of the filters that a document fails comes first among them in equally many orders
        total(fails, lambda m: m.n * (F.lit(n_orders) / F.bit_count(m.mask)).cast("long")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of filters and step: documents kept and removed here, redundant and unique failures,
    good and toxic documents lost, and the filter's Shapley sum over all orders."""
    return orders(histogram(measure(docs), labels))
