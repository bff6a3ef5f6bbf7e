import collections
import random

from sparkmeter.llm import line_dedup


def brute(rows, ratio=line_dedup.RATIO, least=line_dedup.MIN_PAGES):
    pages, seen = collections.Counter(), collections.Counter()
    for _, text, host in rows:
        pages[host] += 1
        seen.update({(host, x.strip(" ")) for x in (text or "").split("\n") if text is not None and x.strip(" ")})
    bad = {(h, x) for (h, x), n in seen.items() if n >= least and n > ratio * pages[h]}
    out = []
    for i, text, host in rows:
        lines = [] if text is None else text.split("\n")
        kept = [x for x in lines if (host, x.strip(" ")) not in bad]
        out.append((i, None if text is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.text, r._lines, r._dropped) for r in line_dedup.drop_boilerplate(df).collect()), key=repr)


def some(seed=2):
    """Hosts of 3, 40 and 300 pages; lines on none, few and many of them; one host holds most pages."""
    rng, rows = random.Random(seed), []
    for host, n in (("small", 3), ("middle", 40), ("hot", 300), (None, 30)):
        for _ in range(n):
            lines = [rng.choice(["menu", " menu ", "footer", "", "  ", "Menu"]) for _ in range(rng.randrange(4))]
            lines += [f"line {rng.randrange(60)}" for _ in range(rng.randrange(4))] + ["once %d" % len(rows)]
            rng.shuffle(lines)
            rows.append((len(rows), "\n".join(lines), host))
    return rows + [(900, None, "hot"), (901, "", "hot"), (902, "menu", "hot"), (902, "menu", "hot"), (None, "menu\nmenu\nx", "hot"), (903, "menu\nown", "alone")]


def test_equal_to_brute_force_with_nulls_blanks_repeats_and_hosts_of_every_size(docs):
    rows = some()
    want = brute(rows)
    assert got(docs(rows)) == want
    assert (902, "", 1, 1) in want and (903, "menu\nown", 2, 0) in want and (900, None, 0, 0) in want and (901, "", 1, 0) in want


def test_a_line_exactly_at_the_ratio_stays(docs):
    at = [(i, "same\nown %d" % i if i < 8 else "own %d" % i, "h") for i in range(100)]
    assert all(not r[3] for r in got(docs(at)))
    over = [*at, (100, "same", "h"), (101, "same", "h")]
    assert sum(r[3] for r in got(docs(over))) == 10


def test_columns_of_clashing_names_stay_or_are_replaced(docs):
    rows = some(5)
    df = docs(rows, _host="a", _drop="b", _kept="c", _lines="d", host="e", pages="f", line_key="g")
    out = line_dedup.drop_boilerplate(df)
    assert got(df) == brute(rows) and set(out.columns) == {*df.columns, "_dropped"}
    assert {(r._host, r._drop, r._kept, r.host, r.pages, r.line_key) for r in out.collect()} == {("a", "b", "c", "e", "f", "g")}


def test_a_very_long_text_and_an_empty_table(docs):
    long = "\n".join(["menu", *map(str, range(200_000))])
    rows = [(0, long, "h"), (1, "menu", "h"), (2, "menu\nx", "h")]
    assert got(docs(rows)) == brute(rows)
    assert line_dedup.drop_boilerplate(docs([])).collect() == []
