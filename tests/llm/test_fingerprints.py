import hashlib
import random

import pytest
from pyspark.sql import functions as F

from sparkmeter.llm import fingerprints as fp
from sparkmeter.llm.queries import QUERIES


def grams(text, k):
    return [text[i : i + k] for i in range(max(1, len(text) - k + 1))] if text else []


def brute(text, value, k, w):
    """Positions chosen: per window the smallest hash, rightmost of equal ones."""
    h = [value[g] for g in grams(text, k)]
    out = []
    for s in range(max(1, len(h) - w + 1)) if h else []:
        low = min(h[s : s + w])
        at = max(i for i in range(s, min(s + w, len(h))) if h[i] == low)
        if at not in out:
            out.append(at)
    return out


TEXTS = [None, "", "a", "short", "x" * 300, "ab" * 90, "é\U0001f600 mixed \t\n text " * 9, "0123456789abcdef", "0123456789abcdef0123456789abcde", "q" * 16 + "z"]


def table(spark, texts):
    return spark.createDataFrame([(i, t, "clash", 1.5) for i, t in enumerate(texts)], "doc_id long, text string, fp string, _copy double")


def test_choice_equals_brute_force(spark):
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choice("abcé ") for _ in range(rng.randrange(400))) for _ in range(40)] + ["".join(rng.choice("ab") for _ in range(20_000))]
    df = table(spark, texts)
    for k, w in ((16, 16), (5, 4), (3, 1)):
        every = sorted({g for t in texts for g in grams(t or "", k)})
        pack = F.shiftright(F.shiftleft(F.xxhash64(F.encode("g", "UTF-32")), fp.PLACE_BITS), fp.PLACE_BITS)
        value = {r.g: r.h for r in spark.createDataFrame([(g,) for g in every], "g string").select("g", pack.alias("h")).collect()}
        rows = fp.fingerprints(df.select("doc_id", "text"), k=k, window=w).collect()
        for r in rows:
            at = brute(r.text or "", value, k, w)
            assert r.fp_positions == at and r.fp_hashes == [value[grams(r.text, k)[i]] for i in at]
    with pytest.raises(ValueError):
        fp.winnow(F.col("text"), 5, 8)


def test_blocks_give_the_same_as_whole_texts(spark):
    rng = random.Random(4)
    texts = TEXTS + ["".join(rng.choice("abcde ") for _ in range(rng.randrange(500))) for _ in range(60)] + ["q" * (fp.BLOCK + 15 + x) for x in range(34)]
    df = table(spark, texts).withColumn("bucket", F.col("doc_id") % 3)
    for k, w in ((16, 16), (3, 4)):
        rows = fp.winnow_blocks(df, ["bucket", "doc_id"], {"a": F.col("text"), "b": F.reverse("text")}, F.struct("text"), k, w)
        rows = rows.select("text", "a", "b", F.sort_array(fp.winnow(F.col("text"), k, w)).alias("x"), F.sort_array(fp.winnow(F.reverse("text"), k, w)).alias("y")).collect()
        assert len(rows) == len(texts) and all(r.a == r.x and r.b == r.y for r in rows)


def test_query_rows(spark, tmp_path):
    rng = random.Random(6)
    texts = [t for t in TEXTS] + ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(2000))) for _ in range(30)]
    ids = sorted(rng.sample(range(-5, 10**6), len(texts)))
    spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in QUERIES["op2_winnowing"](spark, str(tmp_path)).collect()}
    assert len(rows) == len(texts)
    for i, (d, t) in enumerate(zip(ids, texts)):
        t, then = t or "", texts[(i + 1) % len(texts)] or ""
        edited = t[: len(t) - len(t) // 2] + then[: len(t) // 2]
        assert (rows[d].n_chars, rows[d].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= rows[d].near_next <= 1
        if len(t) > 300 and len(set(t)) > 3:
            assert rows[d].near_edited > 0.15 > rows[d].near_next


def test_ties_null_ids_single_rows_and_empty_tables(spark):
    rows = spark.createDataFrame([(None, "x" * 50), (None, None), (1, "same words here"), (1, "same words here"), (2**62, "far away"), (-(2**62), "near")], "doc_id long, text string")
    assert fp.edited_fingerprints(rows).count() == 6
    one = fp.edited_fingerprints(rows.where("doc_id = 2")).collect()
    assert one == []
    alone = fp.edited_fingerprints(rows.where("text = 'near'")).first()
    assert alone.edited_sha256 == hashlib.sha256(b"nene").hexdigest() and alone.next_fp == alone.fp
