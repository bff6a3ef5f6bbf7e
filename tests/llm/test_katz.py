import collections
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from sparkmeter.llm import katz


def toks(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [katz.END]


class Brute:
    def __init__(self, texts, order):
        self.order, self.uni = order, collections.Counter()
        self.after = {k: collections.defaultdict(collections.Counter) for k in range(2, order + 1)}
        for t in texts:
            w = toks(t)
            self.uni.update(w)
            for h, x in self.grams(w):
                for k in self.after:
                    self.after[k][h[order - k :]][x] += 1
        self.n, self.v = sum(self.uni.values()), len(self.uni)
        self.d = {k: katz.discounts(collections.Counter(r for c in a.values() for r in c.values())) for k, a in self.after.items()}

    def grams(self, w):
        row = [katz.START] * (self.order - 1) + w
        return [(tuple(row[i : i + self.order - 1]), x) for i, x in enumerate(w)]

    def p1(self, w):
        return (self.uni.get(w, 0) + 0.1) / (self.n + 0.1 * (self.v + 1))

    def p(self, h, w):
        if not h:
            return self.p1(w)
        seen = self.after[len(h) + 1].get(h)
        if not seen:
            return self.p(h[1:], w)
        c = sum(seen.values())
        kept = {x: self.d[len(h) + 1].get(r, 1.0) * r for x, r in seen.items()}
        s = c / (c + 1) if sum(kept.values()) > c - 1e-9 else 1.0
        if w in seen:
            return s * kept[w] / c
        return (1 - s * sum(kept.values()) / c) / (1 - sum(self.p(h[1:], x) for x in seen)) * self.p(h[1:], w)


def rows(seed, n=120):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") * min(3, int(rng.expovariate(1)) + 1)
    out = [(i, " ".join(word() for _ in range(rng.randrange(40)))) for i in range(n)]
    return out + [(n, None), (n + 1, ""), (n + 2, "A b\x0bC\n\nnew words only"), (None, "a b"), (None, "a b"), (5, "a b"), (5, "a b")]


@pytest.mark.parametrize("order", [2, 3, 4])
def test_scores_equal_brute_force_and_sum_to_one(docs, order):
    some = rows(1)
    df = docs(some, w=1, h="x", key=2, so_far="y")
    held = katz.held_out(F.col("doc_id"))
    flags = {r.doc_id: r.x for r in df.select("doc_id", held.alias("x")).collect()}
    model = katz.train(df.where(~held), order)
    brute = Brute([t for d, t in some if not flags[d]], order)
    assert (model.order, model.tokens, model.types) == (order, brute.n, brute.v)
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in katz.score(df, model, ~held).collect()), key=repr)
    want = []
    for d, t in some:
        w = toks(t)
        want.append((d, len(w), sum(x in brute.uni for x in w), round(sum(math.log10(brute.p1(x)) for x in w), 6), round(sum(math.log10(brute.p(h, x)) for h, x in brute.grams(w)), 6)))
    assert sum(flags.values()) > 3 and got == sorted(want, key=repr)
    for h in [("new",) * (order - 1), *brute.after[order]][:300]:
        assert abs(sum(brute.p(h, w) for w in brute.uni) + brute.p(h, "never seen") - 1) < 1e-9


def test_one_very_long_text(docs):
    model = katz.train(docs([(1, "a b c " * 200_000)]))
    got = katz.score(docs([(2, "a b c " * 100_000)]), model).first()
    assert got.n_tokens == got.n_known == 300_001 and got.base_score < got.score < 0


def test_empty_training_and_empty_tables(docs):
    model = katz.train(docs([]))
    got = katz.score(docs([(1, "a b"), (2, None)]), model).collect()
    assert {(r.doc_id, r.n_tokens, r.n_known) for r in got} == {(1, 3, 0), (2, 1, 0)} and all(r.score == r.base_score == 0 for r in got)
    assert katz.score(docs([]), model).collect() == []


@pytest.mark.parametrize("order", [2, 3, 4])
def test_one_pass_equals_brute_force_in_many_small_parts(docs, order, monkeypatch):
    from sparkmeter.llm import katz_pass

    monkeypatch.setattr(katz_pass, "PART_BYTES", 900)
    some = rows(1) + [(d + 1000, t) for d, t in rows(2, 200)[:200]] + [(7000 + i, "the same line again " * (i % 5)) for i in range(60)]
    df = docs(some, w=1, h="x", key=2, known="y", alike=3)
    flags = {r.doc_id: r.x for r in df.select("doc_id", katz.held_out(F.col("doc_id")).alias("x")).collect()}
    brute = Brute([t for d, t in some if not flags[d]], order)
    told = katz_pass.learn_and_score(df, ~katz.held_out(F.col("doc_id")), order).collect()
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in told), key=repr)
    want = []
    for d, t in some:
        w = toks(t)
        want.append((d, len(w), sum(x in brute.uni for x in w), round(sum(math.log10(brute.p1(x)) for x in w), 6), round(sum(math.log10(brute.p(h, x)) for h, x in brute.grams(w)), 6)))
    assert sum(flags.values()) > 20 and {r.train_tokens for r in told} == {brute.n} and got == sorted(want, key=repr)


def test_one_pass_without_known_rows_or_any_rows(docs):
    from sparkmeter.llm import katz_pass

    got = katz_pass.learn_and_score(docs([(1, "a b"), (2, None)]), F.lit(False)).collect()
    assert {(r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in got} == {(1, 3, 0, 0), (2, 1, 0, 0)} and all(r.score == r.base_score == 0 for r in got)
    assert katz_pass.learn_and_score(docs([]), F.lit(True)).collect() == []


def test_one_pass_packs_eight_bytes_a_token(docs):
    import numpy as np
    import pyarrow as pa

    from sparkmeter.llm import katz_pass

    rng = np.random.default_rng(1)
    texts = [" ".join(f"word{i}" for i in rng.zipf(1.2, 400) if i < 10**6) for _ in range(1500)]
    batch = pa.RecordBatch.from_pydict({"key": list(range(len(texts))), "text": texts, "known": [i % 10 > 0 for i in range(len(texts))]})
    tokens = sum(len(t.split()) + 1 for t in texts)
    often = next(katz_pass.frequent([batch])).column("w").to_numpy().view(np.uint64)
    listed = np.concatenate([np.array([katz_pass.END, katz_pass.START]), often])
    assert sum(len(block) for _, (_, _, block) in katz_pass.blocks([batch], 3, 3, 4, 4, listed, None, 0)) < 8 * tokens
