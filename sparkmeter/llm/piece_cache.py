"""Ids of text pieces that recur: each distinct piece of a batch is encoded once and remembered by a 64-bit key."""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np

from .words import _BASE, _UNDO, _power, mix


def piece_keys(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(data)), out=total[1:])
    return mix(((total[end] - total[start]) * _power(_UNDO, len(data) + 1)[start]) ^ mix((end - start).astype(np.uint64)))


def spread(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... for count[0] places, then from begin[1] on."""
    return np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


class PieceCache:
    """Remembers up to `limit` pieces in sorted arrays; when full it starts anew, which changes no result."""

    def __init__(self, encode: Callable[[list[str]], list], limit: int = 1_500_000):
        self.encode, self.limit = encode, limit
        self._clear()

    def _clear(self):
        self.keys, self.begin, self.count, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def ids_of(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in a row, their number by piece) for the pieces data[start:end]."""
        key, first, which = np.unique(piece_keys(data, start, end), return_index=True, return_inverse=True)
        if len(self.keys) > self.limit:
            self._clear()
        at = np.searchsorted(self.keys, key)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == key[known]
        new = np.flatnonzero(~known)
        if len(new):
            raw = data.tobytes()
            some = first[new]
            found = self.encode([raw[i:j].decode() for i, j in zip(start[some].tolist(), end[some].tolist())])
            even = isinstance(found, np.ndarray)  # a row of ids for each piece
            count = np.full(len(found), found.shape[1]) if even else np.fromiter(map(len, found), np.int64, len(found))
            begin = len(self.ids) + np.cumsum(count) - count
            self.ids = np.concatenate([self.ids, found.ravel() if even else np.fromiter(itertools.chain.from_iterable(found), np.int32, int(count.sum()))])
            where = np.searchsorted(self.keys, key[new])
            self.keys, self.begin, self.count = np.insert(self.keys, where, key[new]), np.insert(self.begin, where, begin), np.insert(self.count, where, count)
            at = np.searchsorted(self.keys, key)
        slot = at[which]
        return self.ids[spread(self.begin[slot], self.count[slot])], self.count[slot]
