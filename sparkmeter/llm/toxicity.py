"""Toxic texts by a support vector machine over a gap-weighted subsequence kernel, approximated on landmark words.

Two words are alike when they share subsequences of three characters, those with gaps counting less, so an insult with
another ending or with characters put into it stays near the insults seen in training. A word is mapped to its kernel
values with the landmarks, whitened by the landmarks' own kernel (Nystrom), and judged by a linear SVM. Labels belong
to texts: every word of a clean text is clean, and of a toxic text at least its witness, the word that toxic texts
prefer most, is toxic. A sentence is as toxic as its worst word, and a text as its worst sentence. Letters that stand
alone, three and more in a row, are read as one word too.
"""

from __future__ import annotations

import dataclasses
import functools
import itertools
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .piece_cache import PieceCache
from .shared import batches_of, save
from .words import CHUNK_BYTES, chunks, words

#: Characters in a subsequence, decay by character of its span, and the power of the kernel, which makes it sharper.
ORDER, DECAY, POWER = 3, 0.6, 3
LANDMARKS = 96
#: Bounds of what training takes to the driver: words of toxic texts, words of clean texts, and hard clean words a round.
TOXIC_WORDS, CLEAN_WORDS, HARD_WORDS, ROUNDS = 1_000, 3_000, 3_000, 2
#: Labels to learn from, about: 12 bytes each, broadcast.
FIT_ROWS = 500_000
#: What the errors on clean words cost, against toxic ones, and errors against a large margin.
CLEAN_COST, COST = 10.0, 10_000.0
MIN_TEXTS = 3
LONGEST, STEP = 16, 8
STEEP = 4.0
#: Words judged at once, and bytes of text: what a Python worker holds does not grow with an Arrow batch.
JUDGED_WORDS, JUDGED_BYTES = 4_096, CHUNK_BYTES // 4
#: Rows with texts in an Arrow batch, where this step runs the job itself.
BATCH_ROWS = 1_000
_OTHER = re.compile(r"[\W\d_]+")


def word_of(raw: str) -> str:
    """Lower case, without what is no letter."""
    low = raw.lower()
    return low if low.isalpha() else _OTHER.sub("", low)


def windows(word: str) -> list[str]:
    """A long word is judged by overlapping parts."""
    return [word] if len(word) <= LONGEST else [word[i : i + LONGEST] for i in range(0, len(word) - STEP, STEP)]


def _codes(some: list[str]) -> np.ndarray:
    return np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(some), -1)


@functools.lru_cache(maxsize=64)
def _places(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all subsequences of ORDER characters in a word of n, and their weights by span."""
    at = np.array(list(itertools.combinations(range(n), ORDER)), np.int64)
    return at, (DECAY ** (at[:, -1] - at[:, 0] + 1)).astype(np.float32)


def by_length(some: list[str]) -> dict[int, np.ndarray]:
    long = np.fromiter(map(len, some), np.int64, len(some))
    return {n: np.flatnonzero(long == n) for n in np.unique(long).tolist()}


@functools.lru_cache(maxsize=64)
def _reach(n: int) -> np.ndarray:
    """Decay from a character to each later one."""
    d = np.subtract.outer(np.arange(n), np.arange(n)) - 1
    return np.where(d >= 0, DECAY ** np.maximum(d, 0), 0).astype(np.float32)


def own_kernel(some: list[str]) -> np.ndarray:
    """Kernel of each word with itself, by the recursion over the ends of common subsequences."""
    out = np.zeros(len(some), np.float32)
    for n, which in by_length(some).items():
        if n < ORDER:
            continue
        left, right = _reach(n), _reach(n).T.copy()
        for part in np.array_split(which, -(-len(which) * n * n // 400_000)):
            c = _codes([some[i] for i in part])
            here = (c[:, :, None] == c[:, None, :]) * np.float32(DECAY**2)
            ends = here
            for _ in range(ORDER - 1):
                ends = here * np.matmul(left, np.matmul(ends, right))
            out[part] = ends.sum((-2, -1))
    return out


@functools.lru_cache(maxsize=8)
def _marked(marks: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The landmarks' characters; the row of each subsequence of these in the table, or -1; weights by landmark; own kernels."""
    letters = np.unique(_codes(["".join(marks)]))
    wide = len(letters) + 1
    found: dict[int, dict[int, float]] = {}
    for j, m in enumerate(marks):
        if len(m) >= ORDER:
            at, weight = _places(len(m))
            c = np.searchsorted(letters, _codes([m])[0]) + 1
            for code, w in zip(((c[at[:, 0]] * wide + c[at[:, 1]]) * wide + c[at[:, 2]]).tolist(), weight.tolist()):
                found.setdefault(code, {})[j] = found.get(code, {}).get(j, 0.0) + w
    row_of, table = np.full(wide**ORDER, -1, np.int32), np.zeros((len(found), len(marks)), np.float32)
    for i, (code, by_mark) in enumerate(sorted(found.items())):
        row_of[code] = i
        for j, w in by_mark.items():
            table[i, j] = w
    return letters, row_of, table, own_kernel(list(marks))


def kernel(some: list[str], marks: list[str]) -> np.ndarray:
    """Normalised kernel to the power POWER, words by landmarks; words of fewer than ORDER characters are like nothing."""
    letters, row_of, table, own = _marked(tuple(marks))
    out, wide = np.zeros((len(some), len(marks)), np.float32), len(letters) + 1
    for n, which in by_length(some).items() if len(table) else ():
        if n < ORDER:
            continue
        at, weight = _places(n)
        for part in np.array_split(which, -(-len(which) * len(at) // 4_000)):
            c = _codes([some[i] for i in part])
            near = np.minimum(np.searchsorted(letters, c), len(letters) - 1)
            c = np.where(letters[near] == c, near + 1, 0).astype(np.int32)  # 0: in no landmark
            row = row_of[((c[:, at[:, 0]] * wide + c[:, at[:, 1]]) * wide + c[:, at[:, 2]]).ravel()]
            hit = np.flatnonzero(row >= 0)
            if len(hit):
                word = hit // len(at)
                new = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
                out[part[word[new]]] = np.add.reduceat(table[row[hit]] * weight[hit % len(at), None], new, axis=0)
    norm = np.sqrt(np.outer(own_kernel(some), own))
    return np.divide(out, norm, out=np.zeros_like(norm), where=norm > 0) ** POWER


@dataclasses.dataclass(frozen=True)
class Model:
    marks: tuple[str, ...]
    whiten: np.ndarray
    weights: np.ndarray  # the last is the bias
    edge: float = 0.0  # the margin from which a text is toxic

    def decide(self, some: list[str]) -> np.ndarray:
        """The margin of each word."""
        if not self.marks:
            return np.full(len(some), self.weights[-1])
        marks, by_mark = list(self.marks), self.whiten @ self.weights[:-1]
        parts = (some[i : i + JUDGED_WORDS] for i in range(0, max(1, len(some)), JUDGED_WORDS))
        return np.concatenate([kernel(part, marks) @ by_mark for part in parts]) + self.weights[-1]


def _machine(x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Linear SVM with squared hinge loss by Newton steps on the rows inside the margin."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(60):
        near = y * (x @ w) < 1
        a = x[near] * cost[near, None]
        new = np.linalg.solve(np.eye(len(w)) + a.T @ x[near], a.T @ y[near])
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w


def _far_apart(some: list[str], n: int) -> list[str]:
    """Words chosen one by one, each the least like those chosen before; the first is the first."""
    if len(some) <= n:
        return some
    chosen, like = [0], kernel(some, [some[0]])[:, 0]
    while len(chosen) < n:
        i = int(np.argmin(like))
        chosen.append(i)
        like = np.maximum(like, kernel(some, [some[i]])[:, 0])
    return [some[i] for i in chosen]


def _variants(word: str, rng: random.Random) -> list[str]:
    """The word with a letter put into it."""
    return [word[:i] + rng.choice("abcdefghijklmnopqrstuvwxyz") + word[i:] for i in (rng.randrange(1, len(word)) for _ in range(2))]


def _fit(toxic: dict[str, int], clean: list[str]) -> Model:
    """toxic: words with their number of texts, the most telling first."""
    if not toxic:
        return Model((), np.zeros((0, 0)), np.array([-1.0]))
    rng, some = random.Random(0), list(toxic)
    marks = _far_apart(some[:400], LANDMARKS * 2 // 3)
    held = set(marks)
    marks += _far_apart([w for w in clean if w not in held][:1_500], LANDMARKS - len(marks)) if clean else []
    values, vectors = np.linalg.eigh(kernel(marks, marks))
    keep = values > 1e-6
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    edited = [(v, 0.3 * toxic[w]) for w in some if toxic[w] >= MIN_TEXTS for v in _variants(w, rng)]
    nothing = [""] * (len(clean) // 10 + 1)  # a word that is like no landmark is clean
    bad = np.array([toxic[w] for w in some] + [n for _, n in edited], float)
    good = np.ones(len(clean) + len(nothing))
    x = kernel(some + [w for w, _ in edited] + clean + nothing, marks) @ whiten
    cost = np.concatenate([bad / bad.sum(), CLEAN_COST * good / good.sum()]) * COST
    return Model(tuple(marks), whiten, _machine(x, np.concatenate([np.ones(len(bad)), -good]), cost))


def _word_column(text: Column) -> Column:
    """Distinct words of a text, as `word_of` makes them, of any length. What is no letter goes from the whole text at once."""
    return F.array_distinct(F.split(F.regexp_replace(F.lower(text), r"[^\p{L} \t-\r]+", ""), r"[ \t-\r]+"))


def _group(text: Column) -> Column:
    """The least hash of two words in a row, which near copies mostly share and other texts don't."""
    raw = F.split(F.lower(text), r"[ \t-\r]+")
    return F.array_min(F.zip_with(raw, F.slice(raw, F.lit(2), F.greatest(F.size(raw) - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b)))


def fit(docs: DataFrame, labels: DataFrame, toxic_words: int = TOXIC_WORDS, clean_words: int = CLEAN_WORDS, hard_words: int = HARD_WORDS, rounds: int = ROUNDS, fit_rows: int = FIT_ROWS) -> Model:
    """A model from docs (doc_id, text) and labels (doc_id, toxic); labels other than 0 and 1 say nothing.

    For each word it is counted, over all labelled texts, in how many toxic and clean ones it stands; texts with the
    same least pair of words by hash count once, so that a text with its copies and near copies does not vouch for all its
    words. The words that most prefer toxic texts are the toxic examples, a sample by hash of the words that don't
    the clean ones. After a fit, the words of clean texts it finds worst, of all their words, are added and it is
    fitted again. At last the margin from which a text is toxic is set where fewest of all labelled texts err.
    Only bounded lists of words, and counts by margin, reach the driver. Without toxic texts nothing is toxic.
    Of more than fit_rows labels, about so many are learned from, by a hash of their doc_id; being few, they go to the
    texts, and texts are not shuffled. A label that is repeated counts once.
    """
    model, _, rows = _learn(docs, labels, toxic_words, clean_words, hard_words, rounds, fit_rows)
    if not model.marks:
        return model
    margins = rows.select("text", "toxic").mapInArrow(_scorer(model), "toxic int, score double, predicted int, margin double")
    with batches_of(docs.sparkSession, BATCH_ROWS):
        return _with_edge(model, margins.select("margin", F.col("toxic").alias("bad"), F.lit(1).alias("n")))


def _learn(docs: DataFrame, labels: DataFrame, toxic_words: int = TOXIC_WORDS, clean_words: int = CLEAN_WORDS, hard_words: int = HARD_WORDS, rounds: int = ROUNDS, fit_rows: int = FIT_ROWS) -> tuple[Model, DataFrame, DataFrame]:
    """The model without its edge, the labels learned from (of, toxic), and the labelled texts (text, toxic, group)."""
    told = labels.select(F.col("doc_id").alias("of"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and of is not null")
    told = save(told.distinct(), "labels")
    share = fit_rows / max(fit_rows, told.count())
    told = told.where(F.pmod(F.xxhash64("of"), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = docs.where("text is not null").join(F.broadcast(told), F.col("doc_id") == F.col("of"))
    rows = save(rows.select("text", told.toxic, _group(F.col("text")).alias("group")), "labelled")
    groups = rows.groupBy("toxic", "group").agg(F.count(F.lit(1)).alias("n")).groupBy().agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
    once = rows.select(F.explode(_word_column(F.col("text"))).alias("word"), "toxic", "group").where(F.length("word").between(ORDER, LONGEST)).distinct()
    counts = once.groupBy("word").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    odds = F.log((F.col("bad") + 0.5) / ((groups[0] or 0) + 1)) - F.log((F.col("good") + 0.5) / ((groups[1] or 0) + 1))
    counts = save(counts.withColumn("odds", odds), "words")
    liked = counts.where((F.col("bad") >= MIN_TEXTS) & (F.col("odds") > 2)).orderBy(F.desc(F.col("bad") * F.col("odds")), "word").limit(toxic_words)
    toxic = {r.word: r.bad for r in liked.collect()}
    clean = [r.word for r in counts.where("bad <= good").orderBy(F.xxhash64("word"), "word").limit(clean_words).collect()]
    model, known = _fit(toxic, clean), set(clean)
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for _ in range(rounds if toxic and clean else 0):
        worst = counts.where("good > 0").select("word").repartition(tasks).mapInArrow(_judged(model), "word string, margin double")
        worst = worst.orderBy(F.desc("margin"), "word").limit(hard_words)
        clean += [r.word for r in worst.collect() if r.word not in known]
        known.update(clean)
        model = _fit(toxic, clean)
    return model, told, rows


def _with_edge(model: Model, margins: DataFrame) -> Model:
    """margins: (margin, bad, n), how many texts have a margin and how many of these are toxic."""
    if not model.marks:
        return model
    steps = margins.groupBy(F.round("margin", 2).alias("at")).agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    steps = sorted((r.at, r.bad, r.n - r.bad) for r in steps.where("at between -2 and 20").collect())
    at, bad, good = (np.array(x, float) for x in zip(*steps))
    errors = np.cumsum(bad) - bad + good.sum() - (np.cumsum(good) - good)  # if texts from at[i] on are toxic
    i = int(np.argmin(np.append(errors, bad.sum())))
    edge = at[-1] + 0.5 if i == len(at) else (at[i] + at[i - 1]) / 2 if i else at[0]
    return dataclasses.replace(model, edge=float(edge))


def fit_score(docs: DataFrame, labels: DataFrame, known: Column, **bounds: int) -> DataFrame:
    """(doc_id, score, predicted) of all docs by the model that `fit` makes of those that are known, each text scored once.

    What `score(docs, fit(docs.where(known), labels))` tells; the margins of the labelled texts are those of all texts.
    """
    model, told, _ = _learn(docs.where(known), labels, **bounds)
    marked = told.groupBy("of").agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("n"))
    seen = known & F.col("text").isNotNull()
    rows = docs.join(F.broadcast(marked), F.col("doc_id") == F.col("of"), "left")
    rows = rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.when(seen, F.col("bad")).alias("bad"), F.when(seen, F.col("n")).alias("n"))
    with batches_of(docs.sparkSession, BATCH_ROWS):
        rows = save(rows.mapInArrow(_scorer(model), "doc_id long, bad long, n long, score double, predicted int, margin double").drop("score", "predicted"), "margins")
    model = _with_edge(model, rows.where("n is not null"))
    beyond = F.least(F.greatest(F.col("margin") - F.lit(model.edge), F.lit(-9.0)), F.lit(9.0))
    out = rows.select("doc_id", (1 / (1 + F.exp(F.lit(-STEEP) * beyond))).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


class _Judge:
    """Margins of words, each distinct word judged once, however it is written; what is remembered is bounded."""

    def __init__(self, model: Model, limit: int = 300_000):
        self.model, self.margins, self.told, self.limit = model, PieceCache(self._margins), {}, limit

    def _margins(self, raw: list[str]) -> np.ndarray:
        some = [word_of(r) for r in raw]
        if len(self.told) > self.limit:
            self.told.clear()
        new = [w for w in dict.fromkeys(some) if w not in self.told]
        if new:
            parts = [windows(w) for w in new]
            count = np.fromiter(map(len, parts), np.int64, len(parts))
            margins = self.model.decide(list(itertools.chain.from_iterable(parts)))
            self.told.update(zip(new, np.maximum.reduceat(margins, np.cumsum(count) - count).tolist()))
        return np.fromiter(map(self.told.__getitem__, some), np.float32, len(some)).view(np.int32)[:, None]

    def __call__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self.margins.ids_of(data, start, end)[0].view(np.float32)


_judges: dict[bytes, _Judge] = {}


def _judge(model: Model) -> _Judge:
    key = repr(model.marks).encode() + model.weights.tobytes()  # not the edge: margins don't depend on it
    if key not in _judges:
        _judges.clear()
        _judges[key] = _Judge(model)
    return _judges[key]


def _spelled(data: np.ndarray, doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[list[str], list[int]]:
    """Three and more words of one character in a row, joined."""
    first = data[start]
    width = np.where(first < 0x80, 1, np.where(first < 0xE0, 2, np.where(first < 0xF0, 3, 4)))
    one = np.append((end - start == width) & ~((first >= 0x30) & (first < 0x3A)), False)
    same = np.append(doc[1:] == doc[:-1], False)
    edge = np.diff(np.concatenate([[0], (one[:-1] & np.append(False, one[:-2] & same[:-1])).astype(int), [0]]))
    texts, owners = [], []
    for a, b in zip(np.flatnonzero(edge == 1) - 1, np.flatnonzero(edge == -1)):
        if b - a >= 3:
            texts.append(b"".join(data[start[i] : end[i]].tobytes() for i in range(a, b)).decode())
            owners.append(int(doc[a]))
    return texts, owners


def _margins(model: Model, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(margin, text, start, end) of every word."""
    _, doc, start, end = words(data, at, lower=False)
    return (_judge(model)(data, start, end) if len(doc) else np.zeros(0, np.float32)), doc, start, end


def _judged(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.decide(b.column(0).to_pylist()).astype(float))], ["word", "margin"])

    return run


def _scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in chunks(batches, "text", JUDGED_BYTES):
            margin, doc, start, end = _margins(model, data, at)
            worst = np.full(rows.num_rows, -2.0)
            if len(doc):
                new = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
                worst[doc[new]] = np.maximum(worst[doc[new]], np.maximum.reduceat(margin, new))
                texts, owners = _spelled(data, doc, start, end)
                if texts:
                    np.maximum.at(worst, owners, np.array([model.decide(windows(word_of(t))).max() for t in texts]))
            score = 1 / (1 + np.exp(-STEEP * np.clip(worst - model.edge, -9, 9)))
            others = [i for i, name in enumerate(rows.schema.names) if name != "text"]
            cols = [rows.column(i) for i in others] + [pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(worst)]
            yield pa.RecordBatch.from_arrays(cols, [rows.schema.names[i] for i in others] + ["score", "predicted", "margin"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted) for each row. Null texts and texts without words score as the cleanest ones do."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_scorer(model), "doc_id long, score double, predicted int, margin double").drop("margin")


def clean_rows(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs whose text is not toxic, with all their columns."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for b in batches:
            if not b.num_rows:
                continue
            said = [x for x in _scorer(model)(iter([b.select(["doc_id", "text"])]))]
            keep = pa.concat_arrays([x.column(x.schema.get_field_index("predicted")) for x in said])
            yield b.filter(pc.equal(keep, 0))

    return docs.select(*names).mapInArrow(run, docs.schema)


def held_out(doc_id: Column) -> Column:
    """Every fifth document by the checksum of its id; those without id are learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))
