import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from sparkmeter.llm import wavelet

PATH = public_tokenizers.path("byte_bpe_50k.json")


def expected(rows):
    t = Tokenizer.from_file(PATH)
    out, start = [], 0
    for d, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


ODD = [None, "", " ", "  two  blanks ", "a b   c", "it's we'll  'tis", "x　 y 　z", "tab\t next\n\n line \n", "naïve café déjà vu", "日本語 の テスト", "\U0001f600 smile \U0001f600", "<|endoftext|> text", "a <|endoftext|> b", "a<|endoftext|>b<|endoftext|>", "x\n<|endoftext|>\ny", "<|endoftext", "|>", "<|end oftext|>", "<|<|endoftext|>|> it's", "a  b", "1 2  33 4.5%", "\u0085 \u0085a b", "ends with blank ", "é é"]


def test_files_hold_what_the_library_says(docs):
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("ab é 日 \n\t .,'1s") for _ in range(rng.randrange(60))) for _ in range(150)] + ["word " * 30_000]
    rows = sorted(zip(rng.sample(range(-50, 10**6), len(texts)), texts))
    shuffled = rng.sample(rows, len(rows))
    path, manifest = wavelet.write_shards(docs(shuffled, part=1, file="clash"), PATH, shard_tokens=700)
    assert manifest.count() > 3
    assert sorted(map(tuple, wavelet.read_shards(path, manifest).collect())) == expected(rows)


def test_empty_tables_null_and_repeated_ids(docs):
    assert wavelet.read_shards(*wavelet.write_shards(docs([]), PATH)).collect() == []
    got = wavelet.read_shards(*wavelet.write_shards(docs([(None, "a"), (None, None), (5, "b c"), (5, "b c")]), PATH)).collect()
    assert sorted((r.doc_id or -1, r.n_tokens) for r in got) == [(-1, 1), (-1, 2), (5, 3), (5, 3)]
    assert sorted(r.start for r in got if r.doc_id == 5) == [3, 6]


def test_matrix_operations_equal_brute_force():
    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 1), (5, 2), (64, 9), (513, 300), (3000, 50_257)):
        ids = rng.integers(0, top, n).astype(np.uint32)
        m, docs, ends = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(ids).to_bytes([None, 7], np.array([0, n])))
        assert docs == [None, 7] and list(ends) == [0, n]
        assert np.array_equal(m.all(), ids) and (not n or np.array_equal(m.access(np.arange(n)), ids))
        for symbol in {0, 1, *ids[:20].tolist(), top + 70_000}:
            for low, high in ((0, n), (n // 3, n // 2), (n, n)):
                at = np.flatnonzero(ids[low:high] == symbol) + low
                assert m.count(symbol, low, high) == len(at) and np.array_equal(m.occurrences(symbol, low, high), at)
