"""SentencePiece encoding and decoding, by a Viterbi search over many words at once.

Words of equal length advance together, one character a step. At each place the hashes of all substrings that end
there probe the sorted keys of the pieces; of the candidates the best is kept with its length as the backpointer.

With a unigram model the best is the largest sum of scores. With a BPE model a piece may follow the best piece before
it only if merging would have left just these two side by side; exactly one candidate does, so the same search gives
the ids that merging in order of score gives, without any merging of words.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .piece_cache import PieceCache, spread
from .words import chunks, mix

BLANK = "▁"
_MUL = np.uint64(0x9E3779B97F4A7C15 | 1)
NONE = np.iinfo(np.int64).max
#: Bytes of text coded at once in a task, and pieces remembered: a Python worker holds some hundred bytes for each.
CHUNK, REMEMBERED = 1 << 20, 400_000


class Pieces:
    """A model's pieces in tables for the search: pieces is a list of (text, score, kind), kind normal, byte or other."""

    def __init__(self, pieces: list[tuple[str, float, str]], unk: int, merges: bool):
        self.merges, self.unk = merges, unk
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == "byte"}
        normal = [(p, s, i) for i, (p, s, kind) in enumerate(pieces) if kind == "normal" and p]
        # single characters first, then the others as merging reaches them: a label says which merge comes first
        normal.sort(key=lambda x: (len(x[0]) > 1, -x[1], x[2]))
        self.text = [p for p, _, _ in normal]
        self.id = np.array([i for _, _, i in normal], np.int32)
        self.score = np.array([s for _, s, _ in normal])
        self.label = {p: n for n, p in enumerate(self.text)}
        self.longest = max(map(len, self.text), default=1)
        self.single = {p for p in self.text if len(p) == 1}
        self.left = np.arange(len(self.text))
        self.right = np.arange(len(self.text))
        usable = np.ones(len(self.text), bool)
        if merges:
            usable = self._splits()
        keep = np.flatnonzero(usable)
        keys = np.array([self._key(self.text[n]) for n in keep], np.uint64)
        order = np.argsort(keys)
        self.keys, self.of_key = keys[order], keep[order]
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces have one hash")

    @staticmethod
    def _key(text: str) -> int:
        h = 0
        for c in text:
            h = (h * int(_MUL) + ord(c) + 1) % (1 << 64)
        return int(mix(np.array([h ^ len(text)], np.uint64))[0])

    def _splits(self) -> np.ndarray:
        """The last merge of each piece; pieces that merging cannot make are not used."""
        made, usable = {}, np.zeros(len(self.text), bool)
        for n, p in enumerate(self.text):
            if len(p) == 1:
                usable[n] = True
                continue
            for cut in range(1, len(p)):
                a, b = self.label.get(p[:cut]), self.label.get(p[cut:])
                if a is not None and b is not None and a < n and b < n and usable[a] and usable[b] and self._side_by_side(made, a, b):
                    made[a, b] = n
                    self.left[n], self.right[n], usable[n] = a, b, True
                    break
        width = len(self.text)
        keys = np.array([a * width + b for a, b in made], np.int64)
        order = np.argsort(keys)
        self.pairs, self.pair_label = keys[order], np.array(list(made.values()), np.int64)[order]
        return usable

    def _side_by_side(self, made: dict, a: int, b: int) -> bool:
        limit = NONE
        while True:
            if made.get((a, b), NONE) < limit:
                return False
            for turn in ((0, 1) if a > b else (1, 0)):
                if turn == 0:
                    limit, a, was = a, int(self.right[a]), a
                    more = a != was
                else:
                    limit, b, was = b + 1, int(self.left[b]), b
                    more = b != was
                if more:
                    break
            else:
                return True

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging would leave piece a before piece b: undo their merges, latest first; no pair that then meets may merge earlier."""
        width = len(self.text)
        ok, todo, limit = np.zeros(len(a), bool), np.arange(len(a)), np.full(len(a), NONE)
        a, b = a.copy(), b.copy()
        while len(todo):
            key = a * width + b
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1) if len(self.pairs) else np.zeros(len(key), np.int64)
            meets = np.where(self.pairs[at] == key, self.pair_label[at], NONE) if len(self.pairs) else np.full(len(key), NONE)
            go = meets >= limit
            todo, a, b, limit = todo[go], a[go], b[go], limit[go]
            na, nb = self.right[a], self.left[b]
            a_first = (a > b) & (na != a) | (a <= b) & (nb == b)
            end = (na == a) & (nb == b)
            ok[todo[end]] = True
            limit = np.where(a_first, a, b + 1)
            a, b = np.where(a_first, na, a), np.where(a_first, b, nb)
            todo, a, b, limit = todo[~end], a[~end], b[~end], limit[~end]
        return ok

    def search(self, words: list[str]) -> list[list[int]]:
        """Ids of each word; characters without a piece become bytes, or the unknown id where a model has no bytes."""
        out: list = [None] * len(words)
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w), []).append(i)
        for n, which in by_length.items():
            step = max(1, 200_000 // max(n, 1))
            for k in range(0, len(which), step):
                some = which[k : k + step]
                for i, ids in zip(some, self._together([words[i] for i in some], n)):
                    out[i] = ids
        return out

    def _together(self, words: list[str], n: int) -> Iterator[list[int]]:
        if not n:
            yield from ([] for _ in words)
            return
        m = len(words)
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(m, n).astype(np.uint64)
        best = np.full((m, n + 1), -np.inf)
        best[:, 0] = 0
        last = np.full((m, n + 1), -1, np.int64)  # label of the piece that ends there, -1 for none or an unknown character
        back = np.zeros((m, n + 1), np.int32)
        prefix = np.zeros((m, n + 1), np.uint64)
        for i in range(n):
            prefix[:, i + 1] = prefix[:, i] * _MUL + chars[:, i] + np.uint64(1)
        unknown = float(self.score.min(initial=0)) - 10
        for i in range(1, n + 1):
            longest = min(self.longest, i)
            size = np.arange(1, longest + 1)
            power = np.array([pow(int(_MUL), int(s), 1 << 64) for s in size], np.uint64)
            h = mix((prefix[:, i, None] - prefix[:, i - size] * power) ^ size.astype(np.uint64))
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            word, col = np.nonzero(self.keys[at] == h)
            piece, before = self.of_key[at[word, col]], last[word, i - size[col]]
            value = best[word, i - size[col]] + (0 if self.merges else self.score[piece])
            if self.merges:
                known = before >= 0
                fits = np.ones(len(word), bool)
                fits[known] = self.compatible(before[known], piece[known])
                value = np.where(fits, value, -np.inf)
            table = np.full((m, longest), -np.inf)
            table[word, col] = value
            labels = np.full((m, longest), -1, np.int64)
            labels[word, col] = piece
            alone = labels[:, 0] < 0  # the character is no piece
            table[alone, 0] = best[alone, i - 1] + (0 if self.merges else unknown)
            pick = np.argmax(table, 1)
            rows = np.arange(m)
            best[:, i], last[:, i], back[:, i] = table[rows, pick], labels[rows, pick], pick + 1
        for r, w in enumerate(words):
            i, ids = n, []
            while i:
                piece = last[r, i]
                if piece >= 0:
                    ids.append(int(self.id[piece]))
                elif self.bytes:
                    ids += [self.bytes[b] for b in reversed(w[i - 1].encode("utf-8", "surrogatepass"))]
                elif not ids or ids[-1] != self.unk:
                    ids.append(self.unk)
                i -= int(back[r, i])
            yield ids[::-1]

    def merge_blanks(self, word: str) -> list[int]:
        """The ids of a word after two and more blanks. Runs of blanks share one score, so their merges go by place,
        which the search can't tell; they are merged one by one."""
        parts = list(word)
        while True:
            found = [(-self.score[n], i) for i in range(len(parts) - 1) if (n := self.label.get(parts[i] + parts[i + 1])) is not None]
            if not found:
                break
            _, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        ids: list[int] = []
        for p in parts:
            ids += [int(self.id[self.label[p]])] if p in self.label else [self.bytes[b] for b in p.encode()] if self.bytes else [self.unk]
        return ids


class Codec:
    """A model file's pieces, its encoder with a memory for words, and its decoder."""

    def __init__(self, model: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        kind = lambda i: "byte" if sp.is_byte(i) else "other" if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else "normal"
        raw = [(sp.id_to_piece(i), sp.get_score(i), kind(i)) for i in range(sp.get_piece_size())]
        self.pieces = Pieces(raw, sp.unk_id(), merges=True)
        if any("\n" in p or BLANK in p.lstrip(BLANK) for p, _, k in raw if k == "normal"):
            raise ValueError("texts can't be cut at blanks and line ends for this model")
        self.out = [bytes([int(p[3:5], 16)]) if k == "byte" else p.replace(BLANK, " ").encode() if k == "normal" else b" \xe2\x81\x87 " if i == sp.unk_id() else b"" for i, (p, _, k) in enumerate(raw)]
        self.size = np.array([len(x) for x in self.out], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(self.out), np.uint8)
        self.cache = PieceCache(self._encode, REMEMBERED)

    def _encode(self, words: list[str]) -> list[list[int]]:
        words = [w.replace(" ", BLANK) for w in words]
        odd = [i for i, w in enumerate(words) if self.pieces.merges and BLANK * 2 in w]
        found = self.pieces.search(["" if BLANK * 2 in w and self.pieces.merges else w for w in words])
        for i in odd:
            found[i] = self.pieces.merge_blanks(words[i])
        return found

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, their number by text). Each text that is not empty gets a blank in front."""
        full = np.diff(at) > 0
        n = len(full)
        begin = at[:-1] + np.cumsum(full) - full  # of texts with their blank
        ends = np.append(begin[1:], len(data) + int(full.sum()))
        moved = np.full(len(data) + int(full.sum()), 0x20, np.uint8)
        keep = np.ones(len(moved), bool)
        keep[begin[full]] = False
        moved[keep] = data
        if not len(moved):
            return np.zeros(0, np.int32), np.zeros(n, np.int64)
        cut = np.zeros(len(moved) + 1, bool)
        blank, line = moved == 0x20, moved == 0x0A
        cut[1:-1] = blank[1:] & ~blank[:-1] | line[1:] | line[:-1]
        cut[begin[full]] = True
        start = np.flatnonzero(cut[:-1])
        ids, count = self.cache.ids_of(moved, start, np.append(start[1:], len(moved)))
        owner = np.searchsorted(ends, start, "right")
        return ids, np.bincount(owner, weights=count, minlength=n).astype(np.int64)

    def decode(self, ids: np.ndarray, count: np.ndarray) -> list[str]:
        """Texts of rows of ids; the blank in front goes, bytes that are no UTF-8 become U+FFFD."""
        size = self.size[ids]
        raw = self.flat[spread(self.begin[ids], size)].tobytes()
        ends = np.append(0, np.cumsum(size))[np.append(0, np.cumsum(count))]
        return [raw[a:b].removeprefix(b" ").decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:])]


@functools.lru_cache(maxsize=2)
def codec(model: str) -> Codec:
    return Codec(model)


def _coder(model: str, text: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        c = codec(model)
        for rows, data, at in chunks(batches, text, CHUNK):
            ids, count = c.encode(data, at)
            ends = np.cumsum(count)
            back = c.decode(ids, count)
            raw = data.tobytes()
            same = [raw[a:b] == t.encode() for a, b, t in zip(at[:-1], at[1:], back)]
            crc = [zlib.crc32(ids[e - n : e].astype("<u4")) for e, n in zip(ends, count)]
            cols = [rows.column(0), pa.array(count), pa.array(crc, pa.int64()), pa.array(same)]
            names = ["doc_id", "n_pieces", "ids_crc32", "round_trip"]
            if with_ids:
                cols += [pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids)), pa.array(back)]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def encode_decode(docs: DataFrame, model: str, text: str = "text", with_ids: bool = True) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, round_trip, ids, decoded) for each row; other columns are not looked at.

    ids are the model's, as its library gives them; ids_crc32 is over them as little-endian 32-bit numbers;
    decoded is made from ids and round_trip says whether it is the text. Null and empty texts have no ids. Only a
    text that holds U+2581 itself comes back changed, with blanks for it.
    """
    schema = "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean" + (", ids array<int>, decoded string" if with_ids else "")
    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(_coder(model, "text", with_ids), schema)
