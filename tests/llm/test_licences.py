import random

from sparkmeter.llm import licences as lc


def brute(rows, templates, least):
    out = []
    sets = [(n, lc.bigrams(lc.normalised(t))) for n, t in templates]
    for d, text in rows:
        lines = (text or "").split("\n")
        for i, unit in [(i, x) for i, x in enumerate(lines)] + ([(-1, text)] if len(lines) > 1 else []):
            mine = lc.bigrams(lc.normalised(unit))
            best = max(((lc.dice(mine, s), -k) for k, (_, s) in enumerate(sets)), default=(0, 0))
            if mine and best[0] >= least - 1e-12:
                out.append((d, i, sets[-best[1]][0], round(round(best[0], 6), 4)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.line, r.licence, round(r.dice, 4)) for r in df.collect()), key=repr)


def test_scan_equals_comparing_every_template(docs):
    rng = random.Random(1)
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, "x"), (None, "Released under the MIT License.")]
    for i in range(120):
        lines = [" ".join(rng.choice(["the", "license", "under", "words", "of"]) for _ in range(rng.randrange(12))) for _ in range(rng.randrange(4))]
        some = rng.choice(lc.TEMPLATES)[1].split()
        for _ in range(rng.randrange(5)):
            some[rng.randrange(len(some))] = rng.choice(["changed", "THE", "(c)"])
        lines.insert(rng.randrange(len(lines) + 1), " ".join(some))
        rows.append((10 + i, "\n".join(lines)))
    rows.append((999, "\n".join(["Copyright (c) 2020 Someone"] + lc.TEMPLATES[3][1].split("\n"))))
    rows.append((1000, "word " * 50_000 + "\nLicensed under CC BY-NC 4.0.\n"))
    rows += rows[5:9]
    for least in (lc.DICE, 0.5):
        assert got(lc.scan(docs(rows, line="x"), least=least)) == brute(rows, lc.TEMPLATES, least)
    assert (999, -1, "MIT", 1.0) in got(lc.scan(docs(rows))) and (1000, 1, "CC-BY-NC-4.0", 1.0) in got(lc.scan(docs(rows)))


def test_empty_tables(docs):
    assert lc.scan(docs([])).collect() == [] and lc.scan(docs([(1, "a b")]), []).collect() == []


def test_passages_equal_comparing_every_run_of_sentences_and_lines():
    """For each template, the best of all runs between breaks, taken from every break on."""
    rng = random.Random(2)
    scanner = lc.Scanner(lc.TEMPLATES, 0.6)
    for _ in range(60):
        lines = []
        for _ in range(rng.randrange(1, 4)):
            lines += [" ".join(rng.choice(["the", "license", "under", "words", "of", "of. A"]) for _ in range(rng.randrange(8))) for _ in range(rng.randrange(4))]
            lines += rng.choice(lc.TEMPLATES[:12])[1].split("\n")
        some, _, breaks = lc.passages("\n".join(lines))
        assert some == lc.normalised("\n".join(lines))
        pairs = list(zip(some, some[1:])) if len(some) > 1 else [(w, "") for w in some]
        ids = {g: n for n, g in enumerate(dict.fromkeys(pairs))}
        for i in range(12):
            best = {}
            for a, s in enumerate(breaks):
                for e in breaks[a + 1 :]:
                    best[s] = max(best.get(s, 0), lc.dice(lc.bigrams(some[s:e]) if e - s > 1 else set(), scanner.sets[i]))
            # a passage that begins before the first word of the template is never the best
            found = {s: v for v, s, _ in scanner._windows(i, ids, [ids[g] for g in pairs], lc.np.array(breaks))}
            assert all(abs(best[s] - v) < 1e-9 for s, v in found.items())
            assert max(best.values(), default=0) < 0.6 or abs(max(found.values()) - max(best.values())) < 1e-9


def test_licence_inside_longer_documents(docs):
    mit = lc.TEMPLATES[3][1]
    wrapped = "\n".join(" * " + x for x in mit.replace(". ", ".\n\n * ").split("\n"))
    long = " ".join(f"word{i}" for i in range(200))
    rows = [(1, f"# A tool\n{long}\n\n## Licence\n{wrapped}\n\n{long} again"), (2, f"{long}. {mit} {long}"), (3, f"{long}\n{mit}\n{long}\n{mit}")]
    rows += [(4, (mit + "\n") * 6000), (5, long + "\n" + "filler " * 700_000 + "\n" + mit)]  # over 4 MiB
    found = {(r.doc_id, r.line, r.last_line, r.licence) for r in lc.scan(docs(rows)).collect() if r.dice > 0.9}
    n = mit.count("\n")
    assert {(1, 4, 4 + wrapped.count("\n"), "MIT"), (2, 0, n, "MIT"), (3, 1, 1 + n, "MIT"), (3, 3 + n, 3 + 2 * n, "MIT")} <= found
    assert {(4, -1, -1, "MIT"), (5, 2, 2 + n, "MIT")} <= found


def test_full_texts_and_notices_of_common_licences(docs):
    texts = [(n, t) for n, t in lc.TEMPLATES if len(t) > 600]
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "EPL-1.0", "Unlicense", "BSD-2-Clause", "BSD-3-Clause", "ISC", "CC0-1.0", "MIT"} <= {n for n, _ in texts}
    around = "\n".join(f"some line {i} of the file" for i in range(400))
    notice = "\n".join(["/* This library is free software; you can redistribute it and/or", " * modify it under the terms of the GNU Lesser General Public",
                        " * License as published by the Free Software Foundation; either", " * version 2.1 of the License, or (at your option) any later version.", " */"])
    rows = [(i, f"{around}\n\n{t}\n{around}") for i, (_, t) in enumerate(texts)] + [(1000, f"{notice}\n{around}"), (1001, f"{around}\n{notice.replace('Lesser', 'Affero').replace('2.1', '3').replace('library', 'program')}")]
    found = {(r.doc_id, r.licence) for r in lc.scan(docs(rows)).collect()}
    assert {(i, n) for i, (n, _) in enumerate(texts)} | {(1000, "LGPL-2.1"), (1001, "AGPL-3.0")} <= found
