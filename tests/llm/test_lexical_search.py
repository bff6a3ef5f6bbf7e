import math
import re
from collections import Counter

import numpy as np
import pytest

from sparkmeter.llm import lexical_search as ls

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
ITEMS = "item_id long, text string"


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute(docs, items, top=50):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out, asked = set(), {}
    for item, t in items:
        asked.setdefault(item, set()).update(terms(t))
    for item, ts in asked.items():
        found = []
        for i, c in held:
            n = sum(c.values())
            m = 100 - 50 + (50 * n * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in ts if c[t])
            if s > 0:
                found.append((-s, i is None, i))
        for k, (s, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:top]):
            out.add((item, k + 1, i, -s))
    return out


def check(docs, spark, rows, items, top=50, **more):
    got = [tuple(r) for r in ls.search(docs(rows, **more), spark.createDataFrame(items, ITEMS), top).collect()]
    assert len(set(got)) == len(got)
    assert set(got) == brute([r[:2] for r in rows], items, top)


def prose(rng, n, kinds):
    return " ".join(f"W{rng.zipf(1.3) % kinds}" for _ in range(n))


def test_search_equals_brute_force(docs, spark):
    rng = np.random.default_rng(3)
    rows = [(i, prose(rng, int(rng.integers(1, 90)), 300)) for i in range(300)]
    check(docs, spark, rows, [(i, prose(rng, 20, 300)) for i in range(9)])


def test_narrow_tiles_and_blocks(docs, spark, monkeypatch):
    """Several blocks of items, tiles of two items, three documents, and a bound of sums that lets few terms together."""
    rng = np.random.default_rng(4)
    rows = [(i, prose(rng, 30, 60)) for i in range(80)]
    items = [(i, prose(rng, 15, 60)) for i in range(7)]
    monkeypatch.setattr(ls, "BLOCK_PAIRS", 20)
    monkeypatch.setattr(ls, "TERM_TILE", 4)
    monkeypatch.setattr(ls, "DOC_TILE", 3)
    monkeypatch.setattr(ls, "ITEM_TILE", 2)
    check(docs, spark, rows, items, top=5)


def test_bound_of_partial_sums():
    """However many terms an item has, no vocabulary tile can reach 2^53."""
    n = 500_000
    tiles = ls._tiles(np.zeros(n, np.int64), np.arange(n), np.full(n, 30_000))
    assert all(w.sum() * ls.MOST_IMPACT < 1 << 53 for _, cells in tiles for _, w in cells)
    assert sum(len(t) for _, cells in tiles for t, _ in cells) == n
    some = ls._tiles(np.zeros(3, np.int64), np.arange(3), np.full(3, 1 << 32))
    assert [len(t) for _, cells in some for t, _ in cells] == [2, 1]


def test_odd_rows(docs, spark):
    """Null ids and texts, ties, repeated documents and items, terms of any letters, clashing columns."""
    rows = [(9, "same words here"), (2, "same words here"), (2, "same words here"), (None, "same words here"), (5, None), (6, ""), (7, "... !"), (8, "Äb ÄB äb\x7fcd e f"), (1, "x " * 5000)]
    items = [(1, "Same"), (1, "WORDS"), (None, "here"), (None, "äb"), (3, None), (4, "?!"), (5, "ÄB ÄB e f"), (6, "nothing like it")]
    check(docs, spark, rows, items, n=1, terms="t", item_id=4, score=2, rank=9)
    check(docs, spark, rows, items, top=2)


def test_empty_tables(docs, spark):
    check(docs, spark, [], [(1, "a")])
    check(docs, spark, [(1, "a")], [])
    check(docs, spark, [(1, None)], [(1, "a")])


def test_long_texts(docs, spark):
    """Pieces of one long text are counted together; a very long term is one term."""
    rows = [(1, "alpha beta " * 400_000 + "y" * 3_000_000), (2, "beta " + "y" * 3_000_000), (3, "y" * 2_999_999)]
    check(docs, spark, rows, [(1, "beta"), (2, "y" * 3_000_000)])


def test_vocabulary_compares_bytes(monkeypatch):
    monkeypatch.setattr(ls, "piece_keys", lambda data, start, end: np.zeros(len(start), np.uint64))
    v = ls.Vocabulary([b"one", b"two", b"three"])
    data = np.frombuffer(b"threetwosix", np.uint8)
    assert v.find(data, np.array([0, 5, 8]), np.array([5, 8, 11])).tolist() == [2, 1, -1]
    assert ls.Vocabulary([]).find(data, np.array([0]), np.array([5])).tolist() == [-1]


@pytest.mark.parametrize("top", [1, 3])
def test_task_keeps_ties(top):
    b = ls._Best(1, top)
    for doc in ([9, 8, 7, 6], [5, 4, 3, 2]):
        b.add(np.array([0]), np.array([[5, 5, 5, 4]]), np.array(doc), np.zeros(4, bool))
    assert b.held[0][1].tolist() == [3, 4, 5][:top]
