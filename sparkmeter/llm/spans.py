"""Spans of bytes found by a table-driven transducer, their hashes, and a hash table that compares what it holds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .piece_cache import piece_keys, spread
from .words import CHUNK_BYTES, mix

#: Bytes that are compared one pair at a time beyond this length, eight bytes a step for all pairs up to it.
_LONG = 64
_LOW = (np.uint64(1) << (np.arange(8, dtype=np.uint64) * np.uint64(8))) - np.uint64(1)


class Transducer:
    """A finite-state machine over classes of bytes that says something at every step.

    `classes` gives each byte its class, `follow[state][class]` the next state and `say[state][class]` the bits said.
    One more class, the last, stands after each text. The state after a byte must depend on the byte's class alone
    (the machine is definite), so the steps of all bytes are looked up at once.
    """

    def __init__(self, classes: np.ndarray, follow: list[list[int]], say: list[list[int]]):
        follow = np.array(follow)
        if (follow != follow[0]).any():
            raise ValueError("the state after a byte must not depend on the state before it")
        self.classes, self.end = classes.astype(np.uint8), follow.shape[1] - 1
        self.after = (follow[0] * follow.shape[1]).astype(np.uint8)
        self.say = np.array(say, np.uint8).ravel()

    def run(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(what is said at each step, first step of each text) for the texts data[at[i]:at[i + 1]]; each has one step more than bytes."""
        n = len(at) - 1
        steps = np.full(len(data) + n, self.end, np.uint8)
        begin = at[:-1] + np.arange(n)
        inner = np.ones(len(steps), bool)
        inner[at[1:] + np.arange(n)] = False
        steps[inner] = self.classes[data]
        state = np.empty(len(steps), np.uint8)
        if len(steps):
            state[0], state[1:] = self.after[self.end], self.after[steps[:-1]]
        return self.say[state + steps], begin


def texts(batch: pa.RecordBatch, apart: np.ndarray, text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, offsets, row numbers) of pieces of the batch's texts, about `limit` bytes at once. Null texts are empty.

    A longer text comes in several pieces, each cut behind a byte that `apart` marks, so a run of other bytes is never cut.
    """
    col = batch.column(batch.schema.get_field_index(text)).cast(pa.large_string()).fill_null("")
    at = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(col):
        j = min(len(col), max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1))
        if j > i + 1 or at[j] - at[i] <= limit:
            yield data[at[i] : at[j]], at[i : j + 1] - at[i], np.arange(i, j)
        else:
            begin, last = int(at[i]), int(at[j])
            while begin < last:
                end = min(begin + limit, last)
                while end < last:
                    gaps = np.flatnonzero(apart[data[max(begin, end - limit) : end]])
                    if len(gaps):
                        end = max(begin, end - limit) + int(gaps[-1]) + 1
                        break
                    end = min(end + limit, last)
                yield data[begin:end], np.array([0, end - begin]), np.array([i])
                begin = end
        i = j


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number."""
    padded = np.append(data, np.zeros(8, np.uint8))
    return np.lib.stride_tricks.as_strided(padded.view(np.uint8), (len(data) + 1, 8), (1, 1))


def _load(eights: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(eights[at]).view("<u8").ravel()


def same(data: np.ndarray, a: np.ndarray, b: np.ndarray, other: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Whether data[a:b] and other[c:d] are the same bytes, pair by pair."""
    size = b - a
    out = size == d - c
    left, right = _eights(data), _eights(other)
    live = np.flatnonzero(out & (size > 0))
    slow = live[size[live] > _LONG]
    live = live[size[live] <= _LONG]
    done = 0
    while len(live):
        rest = np.minimum(size[live] - done, 8)
        x, y = _load(left, a[live] + done), _load(right, c[live] + done)
        apart = x ^ y
        part = rest < 8
        apart[part] &= _LOW[rest[part]]
        out[live[apart != 0]] = False
        done += 8
        live = live[(apart == 0) & (size[live] > done)]
    for i in slow:
        out[i] = np.array_equal(data[a[i] : b[i]], other[c[i] : d[i]])
    return out


def distinct(data: np.ndarray, start: np.ndarray, end: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Numbers of the spans that are the first of their bytes for their owner, by insertion into an open hash table.

    All spans probe at once; of those that find a place empty the first takes it, and the others are compared with
    it byte for byte and go on to the next place unless they are the same.
    """
    n = len(start)
    room = 1 << max(4, int(2 * n).bit_length())
    key = mix(piece_keys(data, start, end) ^ mix(owner.astype(np.uint64) + np.uint64(1)))
    table = np.full(room, -1, np.int64)
    place = (key & np.uint64(room - 1)).astype(np.int64)
    first = np.zeros(n, bool)
    left = np.arange(n)
    while len(left):
        where = place[left]
        empty = table[where] < 0
        table[where[empty][::-1]] = left[empty][::-1]
        held = table[where]
        mine = held == left
        first[left[mine]] = True
        rest, held = left[~mine], held[~mine]
        like = (key[rest] == key[held]) & (owner[rest] == owner[held])
        pick = np.flatnonzero(like)
        like[pick] = same(data, start[rest[pick]], end[rest[pick]], data, start[held[pick]], end[held[pick]])
        left = rest[~like]
        place[left] = (place[left] + 1) & (room - 1)
    return np.flatnonzero(first)


def gather(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of these spans alone, with their new starts and ends."""
    size = end - start
    last = np.cumsum(size)
    return data[spread(start, size)], last - size, last
