import random

import public_tokenizers
import sentencepiece

import corpus_pipeline as cp
import __spark_entry__ as entry

from test_ngram_join import brute as classes
from test_tiling import brute as tiles
from test_toxicity import corpus


def tables(spark, tmp, rows, labels, items):
    full = [(d, t, "en", s, len(t or "")) for d, t, s in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp}/benchmark.parquet")
    return str(tmp)


def test_stages_equal_brute_force(spark, tmp_path):
    rng = random.Random(7)
    some, labels = corpus(rng, 240)
    word = lambda: "w" + str(rng.randrange(9000))
    items = [(i, " ".join(word() for _ in range(25))) for i in range(4)]
    menu = "home about contact"
    rows = [(d, t + f"\nline {d} of it", f"src{d % 2}") for d, t in some]
    for i in range(60):
        base = [word() for _ in range(80)]
        rows.append((1000 + 3 * i, " ".join(base) + "\n" + menu, "src0"))
        if i % 3 == 0:
            rows.append((1001 + 3 * i, menu + "\n" + " ".join(base[:-1] + [word()]), "src1"))
        if i % 7 == 0:
            rows.append((1002 + 3 * i, " ".join(base[:40]) + " " + items[i % 4][1] + " " + " ".join(word() for _ in range(60)), "src2"))
    rows += [(5000, None, "src0"), (5001, "", None), (None, "a text without any id at all", "src1")]
    sf = tables(spark, tmp_path, rows, labels, items)

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    at = docs
    seen = []
    for name, stage in cp.STAGES:
        at = stage(spark, at, sf)
        if name != "sentencepiece":
            assert at.columns == docs.columns
        at = at.persist()
        seen.append({r.doc_id: r for r in at.collect()})
    toxic, lines, single, clean, ids = seen
    bad = {d for d, _, y in labels if y}
    assert set(toxic) == {d for d, _, _ in rows} - bad
    keep = lambda t: t if t is None else "\n".join(x for x in t.split("\n") if x != menu)
    host = {d: s for d, _, s in rows}
    assert {d: r.text for d, r in lines.items()} == {d: keep(r.text) if host[d] in ("src0", "src1") else r.text for d, r in toxic.items()}
    assert all(r.n_chars == len(r.text) for r in lines.values() if r.text is not None)
    group = {d: c for d, _, c in classes([(d, r.text) for d, r in lines.items() if d is not None], 5, 80, 100)}
    assert set(single) == {d for d in lines if d is None or group[d] == d}
    leak = lambda t: any(sum(x[2] for x in tiles(i.split(), (t or "").split(), 5)) >= 0.5 * len(i.split()) for _, i in items)
    assert set(clean) == {d for d, r in single.items() if not any(w in (r.text or "") for w in (items[k][1][:30] for k in range(4))) or not leak(r.text)}
    assert len(clean) < len(single) < len(lines) < len(rows)
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert {d: r.ids for d, r in ids.items()} == {d: sp.encode(r.text or "") for d, r in clean.items()}
    assert all(r.round_trip for r in ids.values())


def test_registered_and_run(spark):
    assert sum(k.startswith("op") and k[2].isdigit() for k in entry.queries()) == 10 and "pipeline" in entry.queries()
    assert entry.queries()["pipeline"](spark, "/root/testdata/sf0.001").count() > 50


def test_near_copies_keep_no_second_copy_of_rows_with_ids_of_their_own(docs, monkeypatch):
    names, save = [], cp.save
    monkeypatch.setattr(cp, "save", lambda df, name: names.append(name) or save(df, name))
    base = [f"w{i}" for i in range(60)]
    rows = [(4, " ".join(base)), (-2, " ".join(base)), (9, " ".join(base[:-1] + ["x"])), (5, "other words of its own here"), (6, None), (7, "")]
    assert {r.doc_id for r in cp.near_copies(None, docs(rows), "").collect()} == {-2, 5, 6, 7} and "rows" not in names
    assert {r.doc_id for r in cp.near_copies(None, docs([*rows, (None, "a b c d e f")]), "").collect()} == {-2, 5, 6, 7, None} and "rows" in names
