import itertools
import random
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sparkmeter.llm import toxicity as tx
from sparkmeter.llm.queries import QUERIES


def brute_kernel(a, b):
    def spans(w):
        out = {}
        for at in itertools.combinations(range(len(w)), tx.ORDER):
            u = "".join(w[i] for i in at)
            out[u] = out.get(u, 0) + tx.DECAY ** (at[-1] - at[0] + 1)
        return out

    k = lambda x, y: sum(v * y.get(u, 0) for u, v in x.items())
    x, y = spans(a), spans(b)
    n = (k(x, x) * k(y, y)) ** 0.5
    return (k(x, y) / n) ** tx.POWER if n else 0.0


def test_kernel_equals_all_subsequences():
    rng = random.Random(1)
    some = ["", "a", "ab", "abc", "idiot", "i.d.i.o.t"] + ["".join(rng.choice("abcdé") for _ in range(rng.randrange(3, 10))) for _ in range(25)]
    got = tx.kernel(some, some)
    assert np.allclose(got, [[brute_kernel(a, b) for b in some] for a in some], atol=1e-4)


def corpus(rng, n=600):
    mild = ["tha" + "".join(rng.choice(["ner", "ing", "ou", "sted", "ble", "re"]) for _ in range(rng.randrange(3))) for _ in range(200)]
    rows, labels = [], []
    for i in range(n):
        some, toxic = [rng.choice(mild) for _ in range(rng.randrange(5, 60))], int(i % 6 == 0)
        if toxic:
            some.insert(rng.randrange(len(some)), rng.choice(["idiot", "Moron!", "worthless", "pathetic,"]))
        rows.append((i, " ".join(some)))
        labels.append((i, 1, toxic))
    return rows, labels


def test_finds_insults_with_gaps_and_other_endings(spark, docs):
    rows, labels = corpus(random.Random(2))
    model = tx.fit(docs(rows), spark.createDataFrame(labels + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int"))
    new = ["tha ing idiot", "tha id-iot ble", "you i d i o t", "idi.ot", "idiots", "worrthless thing", "pathetiic", "MORON", "x" * 60 + " tha", "thaing thaner thaou", "", None, "a b c d e f", "and a 1 2 3 4 b"]
    got = {r.doc_id: r for r in tx.score(docs(list(enumerate(new)), score=9, predicted="x"), model).collect()}
    assert [got[i].predicted for i in range(len(new))] == [1] * 8 + [0] * 6
    assert got[10].score == got[11].score and all(0 <= r.score <= 1 for r in got.values())
    kept = tx.clean_rows(docs(list(enumerate(new)), extra="e"), model).collect()
    assert sorted(r.doc_id for r in kept) == list(range(8, 14)) and kept[0].extra == "e"


def test_labels_beyond_the_bound_are_left_by_hash_and_repeats_count_once(spark, docs):
    texts = docs([(i, f"plain words number {i}" + (" you idiot" if i % 4 == 0 else "")) for i in range(400)])
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(None, 1), (0, 1)], "doc_id long, toxic int")
    every, repeated = tx.fit(texts, labels), tx.fit(texts, labels.union(labels))
    assert every.marks == repeated.marks and np.allclose(every.weights, repeated.weights)
    some = tx.fit(texts, labels, fit_rows=100)
    assert tx.fit(texts, labels.orderBy("toxic"), fit_rows=100).marks == some.marks != ()
    assert {r.predicted for r in tx.score(docs([(1, "you idiot")]), some).collect()} == {1}


def test_no_labels_and_empty_tables(spark, docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = tx.fit(docs([(1, "some words")]), none)
    assert [r.predicted for r in tx.score(docs([(1, "some words"), (None, None)]), model).collect()] == [0, 0]
    assert tx.score(docs([]), model).collect() == []


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op5_string_kernel_svm"](spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    held = rows.where("held_out").join(labels, "doc_id").select("toxic", "predicted").collect()
    bad = [r for r in held if r.toxic == 1]
    assert len(held) > 50 and sum(r.predicted == r.toxic for r in held) / len(held) > 0.95
    assert sum(r.predicted for r in bad) / len(bad) > 0.6


def test_each_text_is_scored_once(spark, docs, monkeypatch):
    """fit_score tells what fit and score tell, from one pass over the texts."""
    texts = [(i, f"you {'idiot' if i % 3 == 0 else 'friend'} number {'abcdefghij'[i % 10]}{'klmno'[i % 5]}x walk {i}") for i in range(60)]
    rows = docs(texts + [(60, None), (None, "you idiot"), (61, "")])
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(50)] + [(7, 1, 1), (60, 1, 1)], "doc_id long, quality int, toxic int")
    known = ~tx.held_out(F.col("doc_id"))
    model = tx.fit(rows.where(known), labels)
    old = {r.doc_id: r for r in tx.score(rows, model).collect()}
    made = []
    monkeypatch.setattr(tx, "_scorer", lambda m, real=tx._scorer: made.append(1) or real(m))
    new = {r.doc_id: r for r in tx.fit_score(rows, labels, known).collect()}
    assert len(made) == 1 and new.keys() == old.keys() and {r.predicted for r in new.values()} == {0, 1}
    assert all(abs(new[k].score - old[k].score) < 1e-12 and new[k].predicted == old[k].predicted for k in old)


def test_a_batch_is_scored_in_bounded_memory():
    """Texts of 8 MB with 150,000 different words in one batch: what is held beside them does not grow with them."""
    rng = random.Random(5)
    some = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)) for _ in range(150_000)]
    model = tx._fit({w: 5 for w in some[:80]}, some[80:400])
    texts = [" ".join(some[i : i + 1_500] * 6) for i in range(0, len(some), 1_500)] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    list(tx._scorer(model)(iter([batch.slice(0, 1)])))
    tracemalloc.start()
    got = pa.Table.from_batches(tx._scorer(model)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.num_rows == len(texts) and peak < 60 << 20
    want = [max([-2.0, *model.decide(sorted(set(t.split())))]) if t else -2.0 for t in texts]
    assert np.allclose(got["margin"].to_numpy(), want, atol=1e-5)
