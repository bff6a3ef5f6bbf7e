import itertools
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import sentencepiece

from sparkmeter.llm.sentencepiece_codec import BLANK, Pieces, encode_decode

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "a", " a", "a ", "  two  blanks   three    four", "line\nline\n\n  x", "tab\tx\r\n", "naïve déjà vu", "日本語のテスト 门", "\U0001f600 \U0001f9ff", "x" * 400, "ab" * 99, "\x00\x01", " " * 40 + "a", "ᄀ zz   b", "<s> </s> <unk> <0x41>", "1234567890 3.14", "é"]


def check(df, texts):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = {r.doc_id: r for r in df.collect()}
    for i, t in enumerate(texts):
        ids = sp.encode(t or "")
        assert rows[i].ids == ids, (t, [sp.id_to_piece(x) for x in rows[i].ids], [sp.id_to_piece(x) for x in ids])
        assert rows[i].n_pieces == len(ids) and rows[i].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        assert rows[i].decoded == (t or "").replace(BLANK, " ") and rows[i].round_trip == (BLANK not in (t or ""))


def test_ids_equal_the_library(docs):
    rng = random.Random(1)
    texts = ODD + [None, "with " + BLANK + " in it", BLANK + "a" + BLANK + "b"]
    texts += ["".join(rng.choice("abeiou tnsr th\n é日.1") for _ in range(rng.randrange(80))) for _ in range(300)]
    check(encode_decode(docs(list(enumerate(texts)), ids="clash", n_pieces=3), MODEL), texts)


def test_whole_table_equals_the_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = [r[0] for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.001/documents.parquet' ORDER BY doc_id").fetchall()]
    check(encode_decode(docs, MODEL), texts)


def test_unigram_rule_finds_the_best_sum():
    rng = random.Random(2)
    for _ in range(30):
        vocabulary = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 4))): -rng.random() * 9 for _ in range(9)}
        p = Pieces([(t, s, "normal") for t, s in vocabulary.items()] + [("?", 0.0, "other")], unk=len(vocabulary), merges=False)
        score = list(vocabulary.values())
        for word in ("".join(w) for w in itertools.product("abc", repeat=4)):
            ids = p.search([word])[0]
            def best(i):
                return 0 if i == len(word) else max([s + best(i + len(t)) for t, s in vocabulary.items() if word.startswith(t, i)] + ([min(score) - 10 + best(i + 1)] if word[i] not in vocabulary else []), default=-1e9)
            if len(vocabulary) not in ids:
                assert abs(sum(score[i] for i in ids) - best(0)) < 1e-9


def test_empty_table(docs):
    assert encode_decode(docs([]), MODEL).collect() == []


def test_a_worker_holds_little_beside_its_batch():
    import tracemalloc

    import pyarrow as pa

    from sparkmeter.llm import sentencepiece_codec as sc

    text = "some words that recur\n" * 500
    batch = pa.RecordBatch.from_arrays([pa.array(range(800)), pa.array([text] * 800)], ["doc_id", "text"])
    sc.codec(MODEL)
    tracemalloc.start()
    assert sum(out.num_rows for out in sc._coder(MODEL, "text", True)(iter([batch]))) == 800
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 150e6, most
