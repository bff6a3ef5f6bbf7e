"""Similar pairs by signatures against brute force, and how little they hold on the way."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from sparkmeter.functions import text
from sparkmeter.operators import alike, chat


def _changed(rng, words, n):
    words = set(words)
    for _ in range(n):
        words.discard(rng.choice(sorted(words)))
        words.add(rng.randrange(1 << 40))
    return sorted(words)


def test_pairs_by_words_equal_brute_force(spark):
    rng = random.Random(5)
    sets = []
    for size in [*range(1, 40), 80, 150, 400]:
        for _ in range(3):
            base = [rng.randrange(1 << 40) if rng.random() < 0.5 else rng.randrange(60) for _ in range(size)]
            sets += [(g, _changed(rng, base, rng.randrange(0, 1 + size // 7))) for g in (1, 1, 2)]
    rows = [(g, i, w) for i, (g, w) in enumerate(sets)] + [(1, 10_000, []), (1, 0, sets[0][1])]
    got = {tuple(r) for r in alike.pairs_by_words(spark.createDataFrame(rows, "group long, node long, words array<long>"), 4, 5).collect()}
    want = {(i, j) for i, (g, v) in enumerate(sets) for j, (k, w) in enumerate(sets)
            if i < j and g == k and 5 * len(set(v) & set(w)) >= 4 * len(set(v) | set(w))}
    assert len(want) > 60 and got == want


def test_pairs_by_bits_equal_brute_force(spark):
    rng = random.Random(6)
    prints = []
    for _ in range(40):
        base = rng.getrandbits(64)
        for _ in range(4):
            x = base
            for b in rng.sample(range(64), rng.randrange(0, 9)):
                x ^= 1 << b
            prints.append((rng.randrange(2), x - (1 << 64) if x >> 63 else x))
    prints += [(0, 0), (0, 0), (0, 1)]
    rows = [(g, i, x) for i, (g, x) in enumerate(prints)]
    got = {tuple(r) for r in alike.pairs_by_bits(spark.createDataFrame(rows, "group long, node long, fp long")).collect()}
    want = {(i, j) for i, (g, x) in enumerate(prints) for j, (k, y) in enumerate(prints)
            if i < j and g == k and x and y and bin((x ^ y) & ((1 << 64) - 1)).count("1") <= 6}
    assert len(want) > 30 and got == want


def test_prompts_of_common_words_are_not_all_compared(spark, monkeypatch):
    """600 unlike prompts out of 300 words: each word is in a third of them, so prefixes of rare words met in nearly every pair."""
    rng = random.Random(7)
    vocabulary = ["".join(rng.choices("bcdfghklmnprtvz", k=7)) for _ in range(300)]
    texts = [" ".join(rng.sample(vocabulary, 100)) for _ in range(600)]
    texts.append(" ".join(texts[17].split()[:95]))
    df = spark.createDataFrame([("c", i, "user", x) for i, x in enumerate(texts)], "conv_id string, idx long, role string, text string")
    stored, save = [], alike.save

    def watched(rows, name):
        stored.append(save(rows, name))
        return stored[-1]

    monkeypatch.setattr(alike, "save", watched)
    got = chat.retries(chat.turn_words(df), use_simhash=False).collect()
    assert [(r.idx, r.retry_of) for r in got] == [(600, 17)]
    widest = max(s.count() for s in stored if {"a", "b"} <= set(s.columns))
    assert widest < 20_000  # of 180,300 pairs
    assert all(f.dataType.simpleString() != "array<string>" for s in stored for f in s.schema)


def test_fingerprints_hold_few_words_at_once(monkeypatch):
    """The same by any slice, equal to sums over the grams' bits; a batch is never held whole as Python strings."""
    rng = random.Random(8)
    names = ["a", "bb", "é漢", "x" * 300, *(f"w{i}" for i in range(60))]
    words = [rng.choices(names, k=rng.choice([0, 1, 2, 40])) if rng.random() > 0.1 else None for _ in range(60)]
    other = [rng.choices(names, k=3) if rng.random() > 0.1 else None for _ in range(60)]

    def fnv(data, h):
        for x in data:
            h = ((h ^ x) * text.FNV_PRIME) & 0xFFFFFFFF
        return h

    def one(feats):
        grams = [g.encode() for g in [*feats, *(f"{a} {b}" for a, b in zip(feats, feats[1:]))]]
        h = [fnv(b"k" + g, text.FNV_BASIS_HIGH) << 32 | fnv(b"k" + g, text.FNV_BASIS_LOW) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    kind, sizes, inner = pa.list_(pa.string()), [], text._fingerprints
    monkeypatch.setattr(text, "_fingerprints", lambda w, f, salt: sizes.append(len(w)) or inner(w, f, salt))
    want = [one(w or f or []) for w, f in zip(words, other)]
    for at_once in (1, 50, 10**6):
        monkeypatch.setattr(text, "WORDS_AT_ONCE", at_once)
        assert [x % 2**64 for x in text.fingerprint_rows(pa.array(words, kind), pa.array(other, kind), b"k").tolist()] == want
        assert max(sizes) < 60 or at_once == 10**6


def test_word_sets_of_a_family_are_held_by_tile_not_by_pair(spark, monkeypatch):
    """60 near copies of 200 words are 1,770 pairs; their sets go once to a task, or once to each tile."""
    rng = random.Random(9)
    base = [rng.randrange(1 << 40) for _ in range(200)]
    sets = [_changed(rng, base, 4) for _ in range(60)]
    df = spark.createDataFrame([(1, i, w) for i, w in enumerate(sets)], "group long, node long, words array<long>")
    for tile in (128, 20):
        monkeypatch.setattr(alike, "TILE", tile)
        tables = {}
        monkeypatch.setattr(alike, "save", lambda rows, name, into=tables: into.setdefault(name, rows.localCheckpoint()))
        assert alike.pairs_by_words(df, 4, 5).count() == 1_770
        held = tables["tiled"].select("tile", F.explode(F.array("a", "b")).alias("node")).distinct().count()
        assert held == 60 if tile == 128 else held < 60 * 6
