"""Languages of texts in two steps: the family first, then the language within it.

A text is described by its hashed byte n-grams within words. Linear support vector machines, one for each family
against the rest, choose the family; within it one machine for each pair of languages votes, equal votes are decided
by the sum of margins. Training takes a bounded sample of the labelled texts, drawn by a hash of doc_id; prediction
reads every text whole.

A text that is null or has no letter is `und` with score 0; so is every text when nothing was learned. Texts whose
language is null teach nothing. A language that FAMILIES does not name is a family of its own. Equal texts get equal
predictions, repeated rows are predicted each, doc_id may be null, other columns are not read.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import texts
from .words import mix

UNKNOWN = "und"
#: Language families by ISO 639-1 code.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "celtic": ("br", "cy", "ga", "gd"),
    "baltic": ("lt", "lv"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "ky", "tr", "tt", "uz"),
    "semitic": ("am", "ar", "he", "mt"),
    "indo-iranian": ("bn", "fa", "gu", "hi", "ku", "mr", "ne", "pa", "ps", "ur"),
}
#: Labelled texts that training takes to the driver, in equal shares for all languages as far as they have them.
TRAIN_TEXTS = 4_000
#: Buckets of hashed n-grams, and the lengths in bytes that are counted.
BUCKETS, SIZES = 4096, (2, 3, 4)
#: Cost of errors against a large margin, passes over the sample, and how fast a margin turns into certainty.
COST, PASSES, STEEP = 4.0, 12, 4.0

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[0x41:0x5B] += np.uint64(32)


def held_out(doc_id: Column) -> Column:
    """Rows that training never sees: crc32 of the id as text is divisible by 5. Without id, none."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def family_of(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang in codes), lang)


def features(batch: pa.RecordBatch) -> np.ndarray:
    """Texts by BUCKETS: square roots of n-gram counts, of length 1. A word's n-grams take in one blank on either side.

    Other ASCII characters than letters count as blanks, and runs of them as one; A-Z count as a-z.
    """
    out = np.zeros((batch.num_rows, BUCKETS), np.float32)
    lowered = pa.RecordBatch.from_arrays([pc.utf8_lower(batch.column(batch.schema.get_field_index("text")).cast(pa.large_string()))], names=["text"])
    for data, at, rows in texts(lowered, ~_LETTER):
        ink, n = _LETTER[data], len(rows)
        keep = ink.copy()  # a run of other bytes is one blank, behind a word
        keep[1:] |= ink[:-1]
        first = at[:-1][np.diff(at) > 0]
        keep[first] = ink[first]
        edges = np.concatenate([at[:-1] + 2 * np.arange(n), at[1:] + 2 * np.arange(n) + 1])
        inner = np.ones(len(data) + 2 * n, bool)
        inner[edges] = False
        steps, kept = np.full(len(inner), np.uint64(0x20)), ~inner
        steps[inner], kept[inner] = np.where(ink, _LOWER[data], np.uint64(0x20)), keep
        owner = np.repeat(np.arange(n), np.diff(at) + 2)[kept]
        steps = steps[kept]
        gaps = np.append(0, np.cumsum(steps == 0x20))
        cell = steps
        for size in range(2, max(SIZES) + 1):
            cell = (cell[:-1] << np.uint64(8)) | steps[size - 1 :]
            if size in SIZES:
                mine = owner[: len(cell)]
                fits = (gaps[size - 1 : -1] == gaps[1 : len(cell) + 1]) & (mine == owner[size - 1 :])
                if size == 2:
                    fits &= cell != 0x2020
                key = (mix(cell[fits] ^ np.uint64(size)) % np.uint64(BUCKETS)).astype(np.int64)
                out[rows] += np.bincount(mine[fits] * BUCKETS + key, minlength=n * BUCKETS).reshape(n, BUCKETS).astype(np.float32)
    np.sqrt(out, out=out)
    return out / np.maximum(np.sqrt((out * out).sum(1, keepdims=True)), 1e-12)


def train_svm(x: np.ndarray, positive: np.ndarray, seed: int = 7) -> np.ndarray:
    """Weights of a linear SVM with squared hinge loss, the last one the bias: coordinate ascent on the dual.

    Errors of the two sides weigh the same in sum, however many texts each side has.
    """
    y = np.where(positive, 1.0, -1.0)
    n, share = len(y), max(1, positive.sum()) / max(1, len(y))
    slack = 1.0 / (2 * COST * np.where(positive, 0.5 / share, 0.5 / max(1e-9, 1 - share)))
    w, alpha, square = np.zeros(x.shape[1] + 1), np.zeros(n), (x * x).sum(1) + 1
    order = np.random.default_rng(seed)
    for _ in range(PASSES):
        for i in order.permutation(n):
            gradient = y[i] * (x[i] @ w[:-1] + w[-1]) - 1 + slack[i] * alpha[i]
            step = max(alpha[i] - gradient / (square[i] + slack[i]), 0.0) - alpha[i]
            if step:
                alpha[i] += step
                w[:-1] += step * y[i] * x[i]
                w[-1] += step * y[i]
    return w


@dataclasses.dataclass
class Model:
    """Languages, their families, and the machines: families by weights, and (language, language) by weights."""

    langs: list[str]
    families: list[str]
    by_family: np.ndarray
    pairs: list[tuple[int, int]]
    by_pair: np.ndarray

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the language, certainty from 0 to 1) of each row of features."""
        family_margin = x @ self.by_family[:, :-1].T + self.by_family[:, -1]
        family = family_margin.argmax(1)
        ranked = np.sort(family_margin, 1)
        sure = _certain(ranked[:, -1] - ranked[:, -2]) if len(self.families) > 1 else np.ones(len(x))
        margin = x @ self.by_pair[:, :-1].T + self.by_pair[:, -1]
        votes, total = np.zeros((len(x), len(self.langs))), np.zeros((len(x), len(self.langs)))
        for k, (a, b) in enumerate(self.pairs):
            votes[:, a] += margin[:, k] > 0
            votes[:, b] += margin[:, k] <= 0
            total[:, a] += margin[:, k]
            total[:, b] -= margin[:, k]
        inside = np.array([self.families.index(family_of(x)) for x in self.langs])[None, :] == family[:, None]
        best = np.where(inside, votes + 0.5 * total / (1 + np.abs(total)), -np.inf).argmax(1)
        for k, (a, b) in enumerate(self.pairs):
            sure = np.where(best == a, np.minimum(sure, _certain(margin[:, k])), np.where(best == b, np.minimum(sure, _certain(-margin[:, k])), sure))
        return best, sure


def _certain(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-STEEP * np.clip(margin, -20, 20)))


def fit(docs: DataFrame) -> Model | None:
    """A model of the languages of `docs`, from TRAIN_TEXTS texts about, drawn by a hash of doc_id (of the text where it is null)."""
    known = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    langs = sorted(counts)
    each = max(1, TRAIN_TEXTS // len(langs))
    share = F.element_at(F.create_map(*(F.lit(v) for k in langs for v in (k, min(1.0, each / counts[k])))), F.col("lang"))
    draw = F.pmod(F.xxhash64(F.coalesce("doc_id", F.xxhash64("text")), F.lit("language")), F.lit(1 << 40)) / float(1 << 40)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                x = features(part)
                row, at = np.nonzero(x)
                each = np.append(0, np.cumsum(np.bincount(row, minlength=len(x)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(1), part.column(2), pa.ListArray.from_arrays(pa.array(each), pa.array(at.astype(np.int32))), pa.ListArray.from_arrays(pa.array(each), pa.array(x[row, at]))], names=["lang", "draw", "at", "x"]
                )

    rows = known.select("text", "lang", draw.alias("draw")).where(F.col("draw") < share).mapInArrow(run, "lang string, draw double, at array<int>, x array<float>").toArrow()
    rows = rows.filter(pc.greater(pc.list_value_length(rows.column("at")), 0)).sort_by([("lang", "ascending"), ("draw", "ascending")]).combine_chunks()
    if not rows.num_rows:
        return None
    x = np.zeros((rows.num_rows, BUCKETS), np.float32)
    at = rows.column("at").combine_chunks()
    x[np.repeat(np.arange(len(x)), at.value_lengths().to_numpy()), at.flatten().to_numpy()] = rows.column("x").combine_chunks().flatten().to_numpy()
    lang = np.array(rows.column("lang").to_pylist())
    langs = sorted(set(lang))
    families = sorted({family_of(v) for v in langs})
    family = np.array([family_of(v) for v in lang])
    by_family = np.array([train_svm(x, family == f) for f in families]) if len(families) > 1 else np.zeros((1, BUCKETS + 1))
    pairs = [(a, b) for a in range(len(langs)) for b in range(a + 1, len(langs)) if family_of(langs[a]) == family_of(langs[b])]
    by_pair = np.array([train_svm(x[(lang == langs[a]) | (lang == langs[b])], lang[(lang == langs[a]) | (lang == langs[b])] == langs[a]) for a, b in pairs]) if pairs else np.zeros((0, BUCKETS + 1))
    return Model(langs, families, by_family.astype(np.float32), pairs, by_pair.astype(np.float32))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score, family): the language of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                b = whole.slice(i, 512)
                letters = pc.match_substring_regex(b.column(1), r"\p{L}").fill_null(False).to_numpy(zero_copy_only=False)
                lang, score, family = np.full(b.num_rows, UNKNOWN, object), np.zeros(b.num_rows), np.full(b.num_rows, UNKNOWN, object)
                if model is not None and letters.any():
                    at, sure = model.predict(features(b.filter(pa.array(letters))))
                    lang[letters], score[letters] = np.array(model.langs, object)[at], sure
                    family[letters] = np.array([family_of(x) for x in model.langs], object)[at]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score.astype(float)), pa.array(family, pa.string())], names=["doc_id", "lang_pred", "score", "family"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, family string")
