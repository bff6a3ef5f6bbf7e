import random
import re

from sparkmeter.llm.components import components
from sparkmeter.llm.ngram_join import link_classes


def shingle_set(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(rows, k, num, den):
    sets = [shingle_set(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None and (r not in least or d < least[r]):
            least[r] = d
    return sorted(((d, len(sets[i]), d if not sets[i] else least.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def noisy(rng, words, share):
    return " ".join(rng.choice("pqrs") + str(rng.randrange(99)) if rng.random() < share else w for w in words)


def planted(seed):
    """Groups of copies at many distances, so that links chain and many pairs lie next to the threshold."""
    rng = random.Random(seed)
    texts = [None, "", "  \t ", "one", "One", "one two", "ONE  TWO", "é É", "É é"]
    for _ in range(14):
        base = [rng.choice("abcdefgh") + str(rng.randrange(300)) for _ in range(rng.choice([3, 8, 15, 40, 90, 160, 400]))]
        texts.append(" ".join(base))
        texts += [noisy(rng, base, rng.choice([0, 0.005, 0.01, 0.02, 0.04])) for _ in range(25)]
    ids = rng.sample(range(10_000), len(texts))
    return list(zip(ids, texts))


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()), key=repr)


def test_classes_equal_brute_force(docs):
    for seed, (k, num, den) in ((1, (3, 90, 100)), (2, (5, 80, 100))):
        rows = planted(seed)
        assert got(link_classes(docs(rows, node=1, root="x", sig=2.5), k, num, den)) == brute(rows, k, num, den)


def test_null_and_repeated_ids_and_empty_tables(docs):
    same = "a b c d e f g h i j"
    rows = [(None, same), (None, same), (None, "only without id here"), (-4, "x y z w"), (7, same), (7, "other words in this one"), (7, "other words in this one"), (3, None), (3, "")]
    assert got(link_classes(docs(rows))) == brute(rows, 3, 90, 100)
    assert got(link_classes(docs([]))) == []
    assert got(link_classes(docs([(1, None)]))) == [(1, 0, 1)]


def test_very_long_text_and_many_copies(docs):
    rng = random.Random(5)
    long = [str(rng.randrange(10**6)) for _ in range(60_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[:-50])), (3, " ".join(long[: len(long) // 2]))] + [(10 + i, "the same old words again") for i in range(500)]
    out = {r[0]: r[2] for r in got(link_classes(docs(rows)))}
    assert out[2] == 1 and out[3] == 3 and {out[10 + i] for i in range(500)} == {10}


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(300)] + [(1000, 1001), (5, 5)], "a long, b long")
    assert {r.node: r.root for r in components(links).collect()} == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000}


def test_wide_sketches_rule_out_long_sets_and_never_a_link():
    """Two long texts without a common word are told apart by sketches, so that their texts are not joined."""
    import numpy as np

    from sparkmeter.llm import ngram_join as nj

    rng = np.random.default_rng(3)
    sizes = np.array([100, 6000, 6000, 5900, 9000, 30_000, 24_000])
    own = [rng.integers(0, 2**63, n, dtype=np.uint64) for n in sizes]
    own[3] = own[1][:5900]  # inside own[1]
    own[6] = own[5][:24_000]
    wide = nj._wide(np.concatenate(own), np.repeat(np.arange(len(sizes)), sizes), sizes).to_pylist()
    assert [len(w) * 8 for w in wide] == [0, 8192, 8192, 8192, 16384, 32768, 32768]
    for i, a in enumerate(own):
        for j, b in enumerate(own):
            least = nj._least_difference(wide[i], wide[j])
            assert least <= len(np.setxor1d(a, b))
            if i and j and not {i, j} <= {1, 3} and not {i, j} <= {5, 6} and i != j:
                assert 9 * least > sizes[i] + sizes[j]  # no link at 0.8
