import itertools
import re

import numpy as np
import pytest

from sparkmeter.llm import filter_audit as fa
from sparkmeter.llm.spans import Transducer, distinct, same

LABELS = "doc_id long, quality int, toxic int"


def brute(rows, labels):
    """rows: (doc_id, text, source). Every order applied to every document."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    docs = []
    for i, text, source in rows:
        t = text or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = set()
        if len(ws) < 50:
            fails.add("A")
        if 100 * len(set(ws)) < 65 * len(ws):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 5 * len(t):
            fails.add("C")
        if re.search(r"[#$%&*|]", t):
            fails.add("D")
        if i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows):
            fails.add("E")
        docs.append((source or "", fails, i in good, i in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = mine
            for k, f in enumerate(order):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                shapley[f] += len(gone)
                out[part, "".join(order), k + 1] = [
                    len(left), len(gone), sum(f in d[1] and bool(d[1] & set(order[:k])) for d in mine), sum(d[1] == {f} for d in mine),
                    sum(d[2] for d in gone), sum(d[3] for d in gone),
                ]
        for key in [k for k in out if k[0] == part]:
            out[key].append(shapley[key[1][key[2] - 1]])
    return {k: tuple(v) for k, v in out.items()}


def check(docs, rows, labels, spark, **more):
    got = fa.audit(docs(rows, **more), spark.createDataFrame(labels, LABELS)).collect()
    found = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got}
    assert len(found) == len(got)
    assert found == brute(rows, labels)


def prose(rng, n, kinds):
    return " ".join(f"w{rng.integers(kinds)}" for _ in range(n))


def test_audit_equals_brute_force(docs, spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(60):
        t = prose(rng, int(rng.integers(1, 120)), int(rng.choice([5, 400])))
        t = t.upper() if rng.random() < 0.2 else t + (" #" if rng.random() < 0.2 else "")
        rows.append((i, t, f"s{i % 3}"))
    rows += [(100 + i, rows[i % 4][1], f"s{i % 4}") for i in range(20)]
    labels = [(i, int(i % 2), int(i % 5 == 0)) for i in range(0, 120, 3)]
    check(docs, rows, labels, spark)


def test_odd_rows(docs, spark):
    """Null ids, texts and sources, repeated rows and labels, equal texts in several parts, clashing columns."""
    long = " ".join(f"x{i}" for i in range(60))
    rows = [
        (None, long, "a"), (3, long, "a"), (3, long, "a"), (1, long, None), (1, long, None), (5, long, ""), (None, None, "a"), (7, None, "a"), (8, "", "b"),
        (9, "É" * 30 + " \x0b\x1c\x85 " + "é |", None), (2, "\t\n ", "a"),
    ]
    labels = [(3, 1, 0), (3, 0, 1), (3, None, None), (None, 1, 1), (5, None, 1), (99, 1, 1)]
    check(docs, rows, labels, spark, part="p", digest="d", n=4, mask=1, good=True, least=2, n_words=3)


def test_empty_tables(docs, spark):
    assert fa.audit(docs([]), spark.createDataFrame([], LABELS)).collect() == []
    rows = [(1, "a b", "s")]
    check(docs, rows, [], spark)


def test_long_texts(docs, monkeypatch):
    """Texts longer than a piece are cut between words only, and their distinct words are counted over all pieces."""
    rng = np.random.default_rng(2)
    texts = [prose(rng, 900_000, 1000), "é" * 3_000_000, ("Ab " * 5 + "y" * 2_500_000 + " ") * 2 + "# end", " " * 5_000_000 + "x"]
    got = {r.doc_id: r for r in fa.measure(docs(list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        ws = t.split()
        assert (got[i].n_words, got[i].n_distinct, got[i].n_points) == (len(ws), len(set(ws)), len(t))


def test_hash_table_compares_bytes(monkeypatch):
    """Words whose hashes are all equal are still told apart."""
    from sparkmeter.llm import spans

    monkeypatch.setattr(spans, "piece_keys", lambda data, start, end: np.zeros(len(start), np.uint64))
    words = [b"a", b"b", b"a", b"longer than eight", b"longer than eighty", b"longer than eight", b"x" * 100, b"x" * 99 + b"y", b"x" * 100, b""]
    end = np.cumsum([len(w) for w in words])
    data = np.frombuffer(b"".join(words), np.uint8)
    start = end - [len(w) for w in words]
    assert distinct(data, start, end, np.zeros(len(words), np.int64)).tolist() == [0, 1, 3, 4, 6, 7, 9]
    assert distinct(data, start, end, np.arange(len(words))).tolist() == list(range(len(words)))


def test_same_and_machine():
    data = np.frombuffer(b"abcdefgh12345678abcdefgh12345679", np.uint8)
    assert same(data, np.array([0, 0, 0]), np.array([16, 15, 0]), data, np.array([16, 16, 5]), np.array([32, 31, 5])).tolist() == [False, True, True]
    with pytest.raises(ValueError):
        Transducer(np.zeros(256, np.uint8), [[0, 0], [1, 0]], [[0, 0], [0, 0]])
