import random

import numpy as np

from sparkmeter.llm import tiling


def brute(a, b, least):
    """Greedy string tiling by comparing everything."""
    free_a, free_b, tiles = [True] * len(a), [True] * len(b), []
    while True:
        best = 0
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and free_a[i + k] and free_b[j + k]:
                    k += 1
                if k > best:
                    best = k
        if best < least:
            return tiles
        for i in range(len(a) - best + 1):
            for j in range(len(b) - best + 1):
                if all(free_a[i : i + best]) and all(free_b[j : j + best]) and a[i : i + best] == b[j : j + best]:
                    tiles.append((i, j, best))
                    free_a[i : i + best] = free_b[j : j + best] = [False] * best
                    break


def test_tiles_equal_brute_force():
    rng = random.Random(1)
    for _ in range(120):
        a = [rng.randrange(1, 4) for _ in range(rng.randrange(25))]
        b = [rng.randrange(1, 4) for _ in range(rng.randrange(40))]
        if rng.random() < 0.5:
            b[5:5] = a[len(a) // 2 :] + [9] + a[: len(a) // 2]
        x, y = np.array(a, np.uint64), np.array(b, np.uint64)
        assert tiling.tile(x, y, 3) == brute(a, b, 3)
        full = sum(t[2] for t in tiling.tile(x, y, tiling.SEED))
        assert sum(t[2] for t in tiling.tile(x, tiling._near(x, y), tiling.SEED)) == full


def test_finds_reordered_passages_and_leaves_the_rest(spark, docs):
    rng = random.Random(2)
    word = lambda: "w" + str(rng.randrange(5000))
    item = [[word() for _ in range(30)] for _ in range(6)]
    items = [(i, " ".join(t), "x") for i, t in enumerate(item)] + [(6, "too short", "x"), (None, None, "x"), (0, " ".join(item[0]), "x"), (7, " ".join(item[5]).upper(), "x")]
    items = spark.createDataFrame(items, "item_id long, text string, row string")
    around = lambda some: " ".join([word() for _ in range(50)] + some + [word() for _ in range(50)])
    rows = [
        (1, around(item[0])), (2, around(item[1][15:] + [word()] * 9 + item[1][:15])), (3, around(item[2][:10])), (4, around([])), (5, None), (6, ""),
        (7, " ".join(item[3]).upper()), (8, around(item[4] + item[1])), (1, around(item[0])), (None, around(item[4])), (9, "too short"), (10, around(item[5])), (11, "a " * 40_000 + " ".join(item[3])),
    ]
    rows += [(100 + i, "the same passage " + " ".join(item[3])) for i in range(300)]
    df = docs(rows, seed=1, item_id=2)
    want = [(1, 0)] * 4 + [(2, 1), (7, 3), (8, 1), (8, 4), (None, 4), (10, 5), (10, 7), (11, 3)] + [(100 + i, 3) for i in range(300)]
    for held in (tiling.HELD_SEEDS, 0):
        tiling.HELD_SEEDS, kept = held, tiling.HELD_SEEDS
        got = [(r.doc_id, r.item_id) for r in tiling.leaks(df, items).collect()]
        tiling.HELD_SEEDS = kept
        assert sorted(got, key=repr) == sorted(want, key=repr)
    left = tiling.without_leaks(df, items)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == [3, 4, 5, 6, 9]
    none = spark.createDataFrame([], "item_id long, text string")
    assert tiling.leaks(df, none).count() == 0 and tiling.leaks(docs([]), items).count() == 0
