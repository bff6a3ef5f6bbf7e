"""Step patterns, resident duplicates and sensitivity against plain Python on small and lopsided inputs."""

import random
import re
import statistics

from pyspark.sql import functions as F

from sparkmeter import scale
from sparkmeter.operators import residency, sensitivity, steps


def some_steps(spark, n=1500):
    rng = random.Random(3)
    rows = [(("hot" if i % 5 else f"s{i % 15}"), i // 400, i, rng.choice(["edit", "verify", "verify", "poll", "poll", "read"]), rng.random() < 0.7, rng.randrange(100), rng.choice([None, 1, 2])) for i in range(n)]
    rows = [(*r[:4], r[4] and r[3] == "verify", *r[5:]) for r in rows]
    return rows, spark.createDataFrame(rows, "session_id string, instr int, k bigint, cls string, failed boolean, context bigint, seen bigint")


def brute_loops(rows):
    out, groups = set(), {}
    for r in rows:
        groups.setdefault(r[:2], []).append(r)
    for (s, i), g in groups.items():
        rel = [(j, "E" if r[3] == "edit" else "F" if r[4] else "P") for j, r in enumerate(g) if r[3] in ("edit", "verify")]
        word, chain, end = "".join(x for _, x in rel), 0, None
        for m in re.finditer("(?=(EF+E))", word):
            a, z = m.start(), m.start() + len(m[1]) - 1
            chain += end != a
            end = z
            span = g[rel[a][0] : rel[z - 1][0] + 1]
            out.add((s, i, g[rel[a][0]][2], g[rel[z - 1][0]][2], g[rel[z][0]][2], z - a - 1, len(span), sum(r[5] for r in span), chain))
    return out


COLS = ["session_id", "instr", "start_k", "failed_k", "end_k", "failures", "steps", "input", "chain"]


def test_loops_equal_a_regex_and_survive_blocks(spark):
    rows, df = some_steps(spark)
    want = brute_loops(rows)
    assert len(want) > 50 and max(r[-1] for r in want) > 5
    assert {tuple(r) for r in steps.loops(df).select(*COLS).collect()} == want
    cut = scale.with_blocks(df, ["session_id"], "k", min_rows=200)
    assert scale.BLOCK in cut.columns
    assert {tuple(r) for r in steps.loops(cut).select(*COLS).collect()} == want
    plain, blocked = ({tuple(r) for r in steps.polling_runs(x).select("session_id", "instr", "start_k", "steps", "input", "identical", "saved").collect()} for x in (df, cut))
    assert plain == blocked and len(plain) > 50
    assert steps.loops(df.limit(0)).collect() == steps.polling_runs(df.limit(0)).collect() == []


def test_step_classes_by_priority(spark):
    uses = [("s", 0, "Read", None, None, 1), ("s", 0, "Edit", None, True, 2), ("s", 1, "Bash", "pytest -q", True, 3), ("s", 2, "Bash", "echo 'git push'; sleep 5", False, 4),
            ("s", 3, "Bash", "git commit -m \"pytest\"", False, None), ("s", 5, None, None, None, None), ("s", 6, "Bash", None, None, 7), ("s", 7, "mcp__a__b", "x", None, 7)]
    calls = spark.createDataFrame([("s", k) for k in range(8)], "session_id string, k bigint")
    got = steps.classify(calls, spark.createDataFrame(uses, "session_id string, call_k bigint, name string, command string, is_error boolean, result_hash bigint"))
    assert {r.k: (r.cls, r.failed) for r in got.collect()} == {0: ("edit", False), 1: ("verify", True), 2: ("poll", False), 3: ("vcs", False), 4: ("text-only", False), 5: ("other", False), 6: ("other", False), 7: ("mcp", False)}


def test_resident_lines(spark):
    a, b, c, d = ("alpha line one here", "beta line two is here", "gamma line three here", "delta line four here")
    rows = [("s", 0, 1, "\n".join([a, b, c, "short"])), ("s", 0, 2, "\n".join(["  1→" + a, "2\t" + b, " " + c + "  ", d])), ("s", 0, 3, b), ("s", 0, 4, "\n".join([b, a, c])), ("s", 0, 5, "\n".join([a, a, a, a])),
            ("s", 0, 6, None), ("s", 0, 7, ""), ("s", 1, 8, "\n".join([a, b, c])), ("s", 1, 9, "<system-reminder>x\ny</system-reminder>" + "\n".join([a, b, c])), (None, 1, 10, a)]
    got = {r.ord: (r.n_lines, r.held_lines, r["class"]) for r in residency.resident_duplicates(spark.createDataFrame(rows, "session_id string, epoch int, ord int, text string")).collect()}
    assert got == {1: (3, 0, "low"), 2: (4, 3, "mostly"), 3: (1, 1, "full"), 4: (3, 0, "low"), 5: (4, 0, "low"), 6: (0, 0, "low"), 7: (0, 0, "low"), 8: (3, 0, "low"), 9: (3, 3, "full"), 10: (1, 0, "low")}


def test_median_without_each_row_equals_recomputation(spark):
    rng = random.Random(8)
    rows = [(g, i, rng.choice([None, *range(6)]) if g != "one" else 4.0) for g, n in (("even", 40), ("odd", 41), ("one", 1), ("two", 2)) for i in range(n)]
    rows = [(g, i, None if v is None else float(v)) for g, i, v in rows]
    df = spark.createDataFrame(rows, "g string, i int, v double")
    for r in sensitivity.median_without(df, ["g"], "v").collect():
        others = [v for g, i, v in rows if g == r.g and i != r.i and v is not None]
        assert r.without == (statistics.median(others) if others else None), r
    got = sensitivity.median_without(df.drop("g"), [], "v").collect()
    assert len(got) == len(rows) and {r.without for r in got} <= {2.0, 2.5, 3.0}
    assert sensitivity.median_without(df.limit(0), ["g"], "v").collect() == []


def test_ratios_without_a_unit_and_their_driver(spark):
    df = spark.createDataFrame([("a", 1, 2), ("a", 1, 2), ("b", 9, 10), ("c", None, 4), (None, 1, 1)], "u string, p int, w int")
    out = sensitivity.ratio_without(df, [], "u", "p", "w")
    assert {r.u: round(r.without, 6) for r in out.collect()} == {"a": round(10 / 15, 6), "b": round(3 / 9, 6), "c": round(12 / 15, 6), None: round(11 / 18, 6)}
    assert sensitivity.drivers(out, [], "u").first().driver == "b"
    alone = sensitivity.ratio_without(df.where("u = 'b'"), [], "u", "p", "w").first()
    assert alone.without is None and alone.pooled == 0.9


def test_rank_correlation_with_ties_nulls_and_a_hot_value(spark):
    rng = random.Random(4)
    rows = [("a", rng.choice([1, 1, 1, rng.randrange(30)]), rng.choice([None, rng.randrange(10)])) for _ in range(400)] + [("flat", 1, i) for i in range(5)]
    df = spark.createDataFrame(rows, "g string, x int, y int")

    def ranks(v):
        return [sum(b < a for b in v) + (sum(b == a for b in v) + 1) / 2 for a in v]

    got = {r.g: r for r in sensitivity.rank_correlations(df, ["g"], "x", y="y").collect()}
    pairs = [(x, y) for g, x, y in rows if g == "a" and y is not None]
    assert got["a"].n == len(pairs) and abs(got["a"].rho - statistics.correlation(*map(ranks, zip(*pairs)))) < 1e-12
    assert got["flat"].rho is None and got["flat"].n == 5


def test_placebos_do_not_hang_on_partitions(spark):
    rows = [("s", k, k % 3 == 0, k % 6 == 0) for k in range(200)] + [("t", 0, True, True)] + [("u", k, None, None) for k in range(3)]
    calls = spark.createDataFrame(rows, "session_id string, k bigint, t boolean, f boolean")
    points = spark.createDataFrame([("s", 0), ("s", 195), ("s", 195), ("t", 0), ("u", 1)], "session_id string, k bigint")
    one, many = ({tuple(r) for r in sensitivity.matched_placebos(c, p, F.col("t"), F.col("f"), window=9, draws=7).collect()} for c, p in ((calls.coalesce(1), points.coalesce(1)), (calls.repartition(7), points.repartition(3))))
    assert one == many
    by = {r[0]: r[1:] for r in one}
    assert by["s"][:3] == (2, 3 + 2, 2 + 1) and by["t"] == (1, 1, 1, 1.0, 1.0) and by["u"] == (1, 0, 0, 0.0, 0.0)
