"""Token ids of documents as wavelet matrices, one file a shard.

A shard's ids are stored as bit planes from the highest bit down; in each plane the tokens stand in the order in which
the plane above put them, zeros before ones. With counts of ones every 512 bits, a token, the number of times an id
occurs in a range, and the places where it occurs are found from the planes alone.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .piece_cache import PieceCache
from .shared import folder, save
from .words import CHUNK_BYTES, chunks

MAGIC = b"WVMX1\0\0\0"
END = 0
SHARD_TOKENS = 1_000_000
DOCS_A_TASK = 10_000
_WORDS = 8  # 64-bit words between two counts


class WaveletMatrix:
    """`n` ids below 2**bits. planes: words of bits, lowest first; ones: ones before every eighth word; zeros by plane."""

    def __init__(self, n: int, planes: np.ndarray, ones: np.ndarray, zeros: np.ndarray):
        self.n, self.planes, self.ones, self.zeros, self.bits = n, planes, ones, zeros, len(zeros)

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        ids, n = np.asarray(ids, np.uint32), len(ids)
        ids = ids.astype(np.uint16) if int(ids.max(initial=0)) < 1 << 16 else ids
        bits = max(1, int(ids.max(initial=0)).bit_length())
        blocks = n // (64 * _WORDS) + 1
        planes, zeros = np.zeros((bits, blocks * _WORDS), np.uint64), np.zeros(bits, np.int64)
        for p in range(bits):
            bit = (ids >> ids.dtype.type(bits - 1 - p)) & ids.dtype.type(1) == 1
            packed = np.packbits(bit, bitorder="little")
            planes[p].view(np.uint8)[: len(packed)] = packed
            zeros[p] = n - int(bit.sum())
            ids = np.concatenate([ids[~bit], ids[bit]])
        sums = np.bitwise_count(planes).reshape(bits, blocks, _WORDS).sum(2, dtype=np.int64)
        return cls(n, planes, np.cumsum(sums, 1) - sums, zeros)

    def _ones_before(self, p: int, i: np.ndarray) -> np.ndarray:
        word, block = i >> 6, i >> 9
        inside = self.planes[p].reshape(-1, _WORDS)[block]
        place = np.arange(_WORDS)
        full = np.where(place < (word & 7)[:, None], np.bitwise_count(inside), 0).sum(1, dtype=np.int64)
        last = self.planes[p][word] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return self.ones[p][block] + full + np.bitwise_count(last).astype(np.int64)

    def _find(self, p: int, k: np.ndarray, one: bool) -> np.ndarray:
        """Place of the k-th (from 0) one or zero of a plane."""
        before = self.ones[p] if one else np.arange(self.ones.shape[1]) * 64 * _WORDS - self.ones[p]
        block = np.searchsorted(before, k, "right") - 1
        inside = np.unpackbits(self.planes[p].reshape(-1, _WORDS)[block].view(np.uint8).reshape(len(k), -1), axis=1, bitorder="little") == one
        return block * 64 * _WORDS + np.argmax(np.cumsum(inside, 1) > (k - before[block])[:, None], axis=1)

    def access(self, at) -> np.ndarray:
        """The ids at these places."""
        i = np.atleast_1d(np.asarray(at, np.int64))
        out = np.zeros(len(i), np.uint32)
        for p in range(self.bits):
            bit = (self.planes[p][i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1
            ones = self._ones_before(p, i)
            i = np.where(bit, self.zeros[p] + ones, i - ones)
            out = out << np.uint32(1) | bit
        return out

    def all(self) -> np.ndarray:
        """All ids in order, as `access` of every place: from the lowest plane up, each plane's zeros and ones are put back to their places."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        out = np.zeros(self.n, kind)
        for p in reversed(range(self.bits)):
            one = np.unpackbits(self.planes[p].view(np.uint8), count=self.n, bitorder="little").view(bool)
            below, out = out, np.zeros(self.n, kind)
            out[one] = below[self.zeros[p] :] | kind(1 << (self.bits - 1 - p))
            out[~one] = below[: self.zeros[p]]
        return out.astype(np.uint32)

    def _range(self, symbol: int, low: int, high: int) -> tuple[int, int]:
        if symbol >> self.bits:
            return 0, 0
        for p in range(self.bits):
            a, b = map(int, self._ones_before(p, np.array([low, high])))
            low, high = (int(self.zeros[p]) + a, int(self.zeros[p]) + b) if symbol >> (self.bits - 1 - p) & 1 else (low - a, high - b)
        return low, high

    def count(self, symbol: int, low: int = 0, high: int | None = None) -> int:
        """How often an id stands in [low, high)."""
        a, b = self._range(symbol, low, self.n if high is None else high)
        return b - a

    def occurrences(self, symbol: int, low: int = 0, high: int | None = None) -> np.ndarray:
        """The places of an id in [low, high), in order."""
        a, b = self._range(symbol, low, self.n if high is None else high)
        at = np.arange(a, b)
        for p in reversed(range(self.bits)):
            if not len(at):
                break
            one = bool(symbol >> (self.bits - 1 - p) & 1)
            at = self._find(p, at - int(self.zeros[p]) if one else at, one)
        return at

    def to_bytes(self, doc_ids: list, ends: np.ndarray) -> bytes:
        """Header, the documents' ids (null: none) and token ends, zeros by plane, counts, planes; parts are deflated."""
        null = np.array([d is None for d in doc_ids], np.uint8)
        ids = np.array([0 if d is None else d for d in doc_ids], np.int64)
        parts = [_deflated(x.tobytes()) for x in (ids, null, ends.astype(np.int64), self.zeros, self.ones, *self.planes)]
        sizes = struct.pack(f"<{len(parts)}Q", *map(len, parts))
        return MAGIC + struct.pack("<4Q", self.n, self.bits, len(ids), self.planes.shape[1]) + sizes + b"".join(parts)

    @classmethod
    def from_bytes(cls, raw: bytes) -> tuple[WaveletMatrix, list, np.ndarray]:
        if raw[:8] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        n, bits, _, width = struct.unpack_from("<4Q", raw, 8)
        sizes = struct.unpack_from(f"<{bits + 5}Q", raw, 40)
        at, parts = 40 + 8 * len(sizes), []
        for size in sizes:
            parts.append(zlib.decompress(raw[at : at + size]))
            at += size
        ids, null, ends, zeros = np.frombuffer(parts[0], np.int64), np.frombuffer(parts[1], np.uint8), np.frombuffer(parts[2], np.int64), np.frombuffer(parts[3], np.int64)
        ones = np.frombuffer(parts[4], np.int64).reshape(bits, -1)
        planes = np.frombuffer(b"".join(parts[5:]), np.uint64).reshape(bits, width)
        return cls(n, planes, ones, zeros), [None if x else int(d) for d, x in zip(ids, null)], ends


def _deflated(raw: bytes) -> bytes:
    """Deflate's own format; parts that look like noise are only stored."""
    look = raw[: 1 << 14]
    return zlib.compress(raw, 1 if len(zlib.compress(look, 1)) < 0.95 * len(look) else 0)


#: What a byte is, one bit each: visible ASCII, a letter, a mark, what may follow a cut blank, the lead of two bytes, a byte within a character.
_INK, _LETTER, _MARK, _AFTER, _LEAD, _INNER = (np.uint8(1 << i) for i in range(6))
_IS = np.zeros(256, np.uint8)
_IS[0x21:0x7F] |= _INK | _MARK | _AFTER
_IS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] |= _LETTER
_IS[[0x27, *range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] &= ~_MARK
_IS[[*range(0xC3, 0xE0), *range(0xE4, 0xF5)]] |= _AFTER
_IS[0xC3:0xE0] |= _LEAD
_IS[0x80:0xC0] |= _INNER


def safe_cuts(data: np.ndarray, at: np.ndarray, whole: re.Pattern | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of the texts that byte-level BPE never joins, so that few different ones need encoding.

    Cut is before one blank between two characters that are not white space, which is told from bytes: ASCII,
    two-byte characters from U+00C0 on, and those whose first byte no white space has; before a mark after a letter
    a-z, the apostrophe left out; and around a single line end between ASCII characters. Elsewhere texts stay uncut,
    which is always right: so around and within what `whole` matches, the names of added tokens, which the library
    takes out of a text before all else.
    """
    cut = np.zeros(len(data) + 1, bool)
    if len(data) > 3:
        has = _IS[data]
        ink, line = (has & _INK).view(bool), data == 0x0A
        before = ink[1:-2] | (((has[:-3] & _LEAD) != 0) & ((has[1:-2] & _INNER) != 0))
        cut[2:-2] = (data[2:-1] == 0x20) & before & ((has[3:] & _AFTER) != 0)
        cut[1:-1] |= (((has[:-1] & _LETTER) != 0) & ((has[1:] & _MARK) != 0)) | (line[1:] & ink[:-1])
        cut[2:-1] |= line[1:-1] & ink[:-2] & ink[2:]
        for m in whole.finditer(data) if whole else ():
            cut[max(0, m.start() - 1) : m.end() + 2] = False
    cut[at] = True
    start = np.flatnonzero(cut[:-1])
    return start, np.append(start[1:], len(data))


@functools.lru_cache(maxsize=2)
def _library(tokenizer: str) -> tuple[PieceCache, re.Pattern | None]:
    """The library's ids by piece, and a pattern of its added tokens' names."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer)
    names = sorted((x.content.encode() for x in t.get_added_tokens_decoder().values() if x.content), key=len, reverse=True)
    cache = PieceCache(lambda pieces: [e.ids for e in t.encode_batch_fast(pieces, add_special_tokens=False)])
    return cache, re.compile(b"|".join(map(re.escape, names))) if names else None


def encode(tokenizer: str, data: np.ndarray, at: np.ndarray, end_id: int = END) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, each followed by end_id; their number by text)."""
    cache, names = _library(tokenizer)
    start, end = safe_cuts(data, at, names)
    ids, count = cache.ids_of(data, start, end) if len(start) else (np.zeros(0, np.int32), np.zeros(0, np.int64))
    n = len(at) - 1
    owner = np.searchsorted(at, start, "right") - 1
    by_text = np.bincount(owner, weights=count, minlength=n).astype(np.int64)
    out = np.full(len(ids) + n, end_id, np.uint32)
    out[np.arange(len(ids)) + np.repeat(np.arange(n), by_text)] = ids
    return out, by_text + 1


def _writer(path: str, tokenizer: str, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        import uuid

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        store, base = fs.FileSystem.from_uri(path)
        store.create_dir(base, recursive=True)
        part, seq, docs, ids, counts, held = TaskContext.get().partitionId(), 0, [], [], [], 0

        def shard():
            matrix = WaveletMatrix.build(np.concatenate(ids))
            raw, name = matrix.to_bytes(docs, np.cumsum(np.concatenate(counts))), f"{uuid.uuid4().hex}.wm"
            with store.open_output_stream(f"{base}/{name}") as f:
                f.write(raw)
            return pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "file": [name], "tokens": [matrix.n], "docs": [len(docs)], "bytes": [len(raw)]})

        for rows, data, at in chunks(batches, limit=CHUNK_BYTES):
            some, count = encode(tokenizer, data, at)
            ids.append(some)
            counts.append(count)
            docs += rows.column(0).to_pylist()
            held += len(some)
            if held >= shard_tokens:
                yield shard()
                seq, docs, ids, counts, held = seq + 1, [], [], [], 0
        if docs:
            yield shard()

    return run


def write_shards(docs: DataFrame, tokenizer: str, shard_tokens: int = SHARD_TOKENS) -> tuple[str, DataFrame]:
    """The folder of the files, and (part, seq, file, tokens, docs, bytes, first) of each: `first` tokens lie before it.

    Texts are in ascending order of doc_id (nulls first, equal ones by text) across (part, seq). A task holds one
    shard. A task that is run again writes files of other names; only those that Spark commits are listed.
    """
    path = folder(docs.sparkSession, "wavelet")
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // DOCS_A_TASK))
    tie = F.xxhash64("text")
    dealt = docs.select("doc_id", "text").repartitionByRange(tasks, "doc_id", tie).sortWithinPartitions("doc_id", tie)
    made = save(dealt.mapInArrow(_writer(path, tokenizer, shard_tokens), "part long, seq long, file string, tokens long, docs long, bytes long"), "shards")
    parts = made.groupBy("part").agg(F.sum("tokens").alias("n"))  # one row for each task of the writing
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.sum("tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("tokens")
    return path, save(made.withColumn("inside", inside).join(parts, "part").withColumn("first", F.col("before") + F.col("inside")).drop("before", "inside"), "manifest")


def _reader(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(path)
        for b in batches:
            for name, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with store.open_input_stream(f"{base}/{name}") as f:
                    matrix, docs, ends = WaveletMatrix.from_bytes(f.read())
                ids = matrix.all().astype("<u4")
                starts = np.append(0, ends[:-1])
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts, ends)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts + first), pa.array(ends - starts), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_shards(path: str, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files. Each file is read in a task as it comes."""
    files = manifest.select("file", "first")
    return files.repartition(max(1, min(files.count(), 100_000))).mapInArrow(_reader(path), "doc_id long, start long, n_tokens long, ids_crc32 long")
