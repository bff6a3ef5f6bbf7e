"""Words and word shingles of many texts at once, as 64-bit hashes, with numpy over Arrow's own buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once in a task; one longer text is handled alone.
CHUNK_BYTES = 2 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_UNDO = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[0x41:0x5B] += np.uint64(32)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.ones(max(n, CHUNK_BYTES + 2), np.uint64)
        np.cumprod(np.full(len(have) - 1, base, np.uint64), out=have[1:])
        if n <= CHUNK_BYTES + 2:
            _powers[int(base)] = have
    return have[:n]


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with about `limit` bytes of text: (rows, bytes, offsets). Null texts are empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(text)).cast(pa.large_string()).fill_null("")
        at = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
        data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
        i = 0
        while i < len(col):
            j = min(len(col), max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1))
            yield batch.slice(i, j - i), data[at[i] : at[j]], at[i : j + 1] - at[i]
            i = j


def words(data: np.ndarray, at: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, start, end) of every run of bytes other than blank, tab to carriage return, A-Z as a-z."""
    none = np.zeros(0, np.int64)
    if not len(data):
        return np.zeros(0, np.uint64), none, none, none
    ink = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    begins, ends = ink.copy(), ink
    begins[1:] &= ~ink[:-1] | edge[1:-1]
    ends = ink.copy()
    ends[:-1] &= ~ink[1:] | edge[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    values = (_LOWER[data] if lower else data.astype(np.uint64)) + np.uint64(1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values * _power(_BASE, len(data)), out=total[1:])
    h = (total[end] - total[start]) * _power(_UNDO, len(data))[start]
    return mix(h ^ mix((end - start).astype(np.uint64))) | np.uint64(1), np.searchsorted(at, start, "right") - 1, start, end


def shingles(h: np.ndarray, doc: np.ndarray, n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of the distinct runs of k words, sorted by both; fewer words are one run, no words none."""
    count = np.bincount(doc, minlength=n_docs)
    first = np.cumsum(count) - count
    runs = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    owner = np.repeat(np.arange(n_docs), runs)
    begin = first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs)
    padded, last = np.append(h, np.zeros(k, np.uint64)), (first + count)[owner]
    run = np.zeros(len(owner), np.uint64)
    for j in range(k):
        run = mix(run * np.uint64(0x100000001B3) + np.where(begin + j < last, padded[begin + j], np.uint64(0)))
    order = np.argsort(run)
    order = order[np.argsort(owner[order].astype(np.uint16 if n_docs < 65536 else np.int64), kind="stable")]
    run, owner = run[order], owner[order]
    new = np.ones(len(run), bool)
    new[1:] = (run[1:] != run[:-1]) | (owner[1:] != owner[:-1])
    return run[new], owner[new]


def longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), longs(values))
