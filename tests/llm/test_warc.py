import hashlib
import random

from sparkmeter.llm import warc

PAGES = "page_id long, url string, html string, archive string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], PAGES).repartition(4)


def expected(rows):
    out = []
    for page, _, html in rows:
        body = (html or "").encode()
        best = max((p for p, _, h in rows if (h or "").encode() == body and p is not None), default=None)
        again = len(body) >= 1000 and best is not None and page != best
        out.append((page, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", best if again else None))
    return sorted(out, key=repr)


def test_round_trip_with_copies_nulls_and_small_archives(spark):
    rng = random.Random(3)
    bodies = [None, "", "é" * 499 + "x", "é" * 500, "a" * 999, "a" * 1000, "a\r\n\r\nb" * 400, "\U0001f600" * 30_000]
    rows = [(i, rng.choice([None, "", "not a url", "http://[bad", "https://WWW.Example.com:443/A?b=C", "http://x.org/" + str(i % 3)]), rng.choice(bodies)) for i in range(150)]
    rows += [(None, "http://n.org", "n" * 2000), (None, "http://n.org", "n" * 2000), (149, "http://again.org", "a" * 1000), (-7, "http://minus.org/\r\nX: y", "a" * 1000)]
    got = warc.round_trip(table(spark, rows), archive_bytes=4_000, range_captures=10)
    assert sorted((tuple(r) for r in got.drop("url").collect()), key=repr) == expected(rows)
    assert warc.round_trip(table(spark, [])).collect() == []


def test_index_is_globally_ordered_and_whole(spark):
    rows = [(i, "http://one.example.org/hot" if i % 3 else f"http://h{i % 7}.example.com/{i}", "x" * (i % 50)) for i in range(600)]
    path, archives = warc.write_archives(table(spark, rows), archive_bytes=2_000)
    assert archives.count() > 8
    index = warc.merged_index(path, archives, range_captures=40).collect()
    keys = [(r.url_key, r.stamp, r.page_id) for r in sorted(index, key=lambda r: (r.part, r.place))]
    assert keys == sorted((warc.url_key(u), warc.stamp(p), p) for p, u, _ in rows)
    assert max(sum(r.part == p for r in index) for p in {r.part for r in index}) < 200


def test_loser_tree_merges_any_number_of_runs():
    rng = random.Random(1)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted((rng.randrange(20),) for _ in range(rng.randrange(9))) for _ in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)
