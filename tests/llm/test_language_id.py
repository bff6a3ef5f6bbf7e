import zlib

import numpy as np
import pyarrow as pa
import pytest

from sparkmeter.llm import language_id as li

WORDS = {
    "en": "the of and to in that with from this have which they been were would there their".split(),
    "de": "der die und das nicht mit von auch sich werden über für einen keine wurde".split(),
    "fr": "le les des que dans une pour pas être avec sont plus très même où".split(),
    "es": "el los que una por para con está pero más también años ñandú según".split(),
    "xx": "qxa zqo vqi kqu xqa wqe jqi".split(),
}


def prose(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang], n))


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double, family int").repartition(3)


def learned(spark, n=300):
    rng = np.random.default_rng(5)
    langs = list(WORDS)
    return table(spark, [(i, prose(rng, langs[i % 5], 40), langs[i % 5] if i % 11 else None, "s", 0.5, 1) for i in range(n)])


@pytest.fixture(scope="module")
def model(spark):
    return li.fit(learned(spark))


def test_families_then_pairs(model):
    assert model.langs == ["de", "en", "es", "fr", "xx"]
    assert model.families == ["germanic", "romance", "xx"]
    assert model.pairs == [(0, 1), (2, 3)]


def test_held_out_accuracy(spark, model):
    rng = np.random.default_rng(6)
    truth = {1000 + i: list(WORDS)[i % 5] for i in range(200)}
    got = li.predict(table(spark, [(i, prose(rng, v, 15), None, None, None, None) for i, v in truth.items()]), model).collect()
    assert len(got) == 200 and np.mean([truth[r.doc_id] == r.lang_pred for r in got]) >= 0.99
    assert all(0 <= r.score <= 1 for r in got)


def test_odd_rows(spark, model):
    rows = [(1, None), (2, ""), (3, "123 .. €。 \t"), (None, "der die und"), (5, "Der DIE und"), (5, "Der DIE und"), (6, "x"), (7, "the of and " * 700_000), (8, "å" * 3_000_000)]
    got = sorted(((r.doc_id, r.lang_pred, r.score) for r in li.predict(table(spark, [(*r, "en", None, 1.0, 2) for r in rows]), model).collect()), key=str)
    by = {i: (v, s) for i, v, s in got}
    assert len(got) == len(rows) and got.count((5, *by[5])) == 2
    assert by[1] == by[2] == by[3] == ("und", 0.0)
    assert by[None] == by[5] and by[5][0] == "de" and by[7][0] == "en"
    assert by[6][0] in WORDS and by[8][0] in WORDS


def test_nothing_learned(spark, model):
    none = learned(spark).where("false")
    assert li.fit(none) is None
    assert li.predict(none, model).collect() == []
    assert [tuple(r) for r in li.predict(table(spark, [(1, "the", "en", None, None, None)]), None).collect()] == [(1, "und", 0.0, "und")]
    assert li.fit(table(spark, [(1, "...", "en", None, None, None)])) is None
    one = li.fit(table(spark, [(1, "the and of", "en", None, None, None)]))
    assert [r.lang_pred for r in li.predict(table(spark, [(1, "le des", "fr", None, None, None)]), one).collect()] == ["en"]


def test_features_do_not_depend_on_neighbours_or_pieces(monkeypatch):
    texts = ["Ab c", "d.", "", " e--f ", None, "ab  C", "g"]
    together = li.features(pa.record_batch({"text": pa.array(texts)}))
    for i, t in enumerate(texts):
        assert np.array_equal(together[i], li.features(pa.record_batch({"text": pa.array([t], pa.string())}))[0])
    assert np.array_equal(together[0], together[5])
    long = "words of some length, and. more! " * 20
    whole = li.features(pa.record_batch({"text": pa.array([long])}))
    monkeypatch.setattr(li, "texts", lambda batch, apart: __import__("sparkmeter.llm.spans", fromlist=["texts"]).texts(batch, apart, limit=64))
    assert np.allclose(whole, li.features(pa.record_batch({"text": pa.array([long])})))


def test_features_equal_brute_force():
    t = "Le café, 3 fois"
    counts = {}
    for w in ["le", "café", "fois"]:
        raw = b" " + w.encode() + b" "
        for n in li.SIZES:
            for i in range(len(raw) - n + 1):
                counts[raw[i : i + n]] = counts.get(raw[i : i + n], 0) + 1
    x = np.zeros(li.BUCKETS)
    for gram, c in counts.items():
        x[int(li.mix(np.array([int.from_bytes(gram, "big")], np.uint64) ^ np.uint64(len(gram)))[0] % np.uint64(li.BUCKETS))] += c
    x = np.sqrt(x)
    assert np.allclose(li.features(pa.record_batch({"text": pa.array([t])}))[0], x / np.linalg.norm(x), atol=1e-6)


def test_query_learns_outside_the_held_out_fold(spark, tmp_path):
    from sparkmeter.llm.queries import QUERIES

    learned(spark).write.parquet(f"file://{tmp_path}/documents.parquet")
    got = QUERIES["op11_language_id"](spark, f"file://{tmp_path}").collect()
    assert len(got) == 300
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert np.mean([r.lang_pred == list(WORDS)[r.doc_id % 5] for r in got]) > 0.98
