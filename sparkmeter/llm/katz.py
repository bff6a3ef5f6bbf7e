"""A Katz backoff model of any order, with Good-Turing discounts and exactly normalised backoff weights.

At order k, P_k(w | h) is s(h) d_k(r) r / c(h) for a word seen r times after the history h of k - 1 words, else
a(h) P_{k-1}(w | h'), where h' is h without its first word; after a history that was never seen, a(h) is 1. The base is
P_1(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)) for words and the end of a text, with c = 0 for all that was not seen. d_k(r) is
Katz's discount for r up to TOP and 1 above. a(h) makes the sum over all w exactly 1; where nothing after h is
discounted, s(h) = c(h) / (c(h) + 1) keeps something back for it.
"""

from __future__ import annotations

import dataclasses
import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import save

ADD, TOP = 0.1, 5
#: What stands before a text's first word and after its last; no word is empty or holds a line end or a blank.
START, END, BLANK = "", "\n", " "
ORDER = 3


def held_out(doc_id: Column) -> Column:
    """Every tenth document by the checksum of its id; those without id are learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 10 == 0, F.lit(False))


def words(text: Column) -> Column:
    """Words with A-Z as a-z; null and empty texts have none."""
    letters = "".join(map(chr, range(65, 91)))
    low = F.translate(F.coalesce(text, F.lit("")), letters, letters.lower())
    return F.array_remove(F.split(low, r"[\x20\x09-\x0D]+"), "")


def grams(some: Column, order: int) -> Column:
    """(h, w) of every token, the end included: its history of order - 1 words, parted by blanks, and itself."""
    row = F.concat(F.array_repeat(F.lit(START), order - 1), some, F.array(F.lit(END)))
    part = lambda i: F.slice(row, F.lit(i + 1), F.size(row) - (order - 1))
    before = F.arrays_zip(*[part(i).alias(f"h{i}") for i in range(order - 1)], part(order - 1).alias("w"))
    return F.transform(before, lambda t: F.struct(F.concat_ws(BLANK, *[t[f"h{i}"] for i in range(order - 1)]).alias("h"), t["w"].alias("w")))


def shorter(h: Column) -> Column:
    """A history without its first word."""
    return F.substr(h, F.instr(h, BLANK) + 1)


def discounts(n: dict[int, int], top: int = TOP) -> dict[int, float]:
    """Katz's d(r) for r = 1..top from the numbers n[r] of grams seen r times.

    Where these numbers are too few for Good and Turing, so that some d(r) would not lie in (0, 1], half a count goes.
    """
    few = {r: (r - 0.5) / r for r in range(1, top + 1)}
    if not all(n.get(r) for r in range(1, top + 2)):
        return few
    rest = (top + 1) * n[top + 1] / n[1]
    if rest >= 1:
        return few
    found = {r: ((r + 1) * n[r + 1] / (r * n[r]) - rest) / (1 - rest) for r in range(1, top + 1)}
    return found if all(0 < d <= 1 for d in found.values()) else few


@dataclasses.dataclass(frozen=True)
class Model:
    """Tables in the shared folder: unigrams (w, c, p), and for each order above 1 grams (h, w, logp, p1) and weights (h, a)."""

    unigrams: DataFrame
    grams: dict[int, DataFrame]
    weights: dict[int, DataFrame]
    tokens: int
    types: int

    @property
    def order(self) -> int:
        return max(self.grams)

    @property
    def unseen(self) -> float:
        """P_1(w) of what was not seen."""
        return ADD / (self.tokens + ADD * (self.types + 1))


def train(docs: DataFrame, order: int = ORDER) -> Model:
    """A model of all texts of docs, of two words or more. Counts are combined before each shuffle, so frequent words are no hot keys.

    Texts are read once: each token stands in one gram of every order, so the counts of an order are sums over those of
    the next. What was seen at one order was seen at all below, so the probabilities that a weight needs are rows of
    the table before.
    """
    if order < 2:
        raise ValueError("the order is two or more")
    seen = docs.select(F.explode(grams(words(F.col("text")), order)).alias("t")).select("t.h", "t.w")
    counts = {order: save(seen.groupBy("h", "w").agg(F.count(F.lit(1)).alias("r")), f"counts{order}")}
    for k in range(order - 1, 1, -1):
        counts[k] = save(counts[k + 1].groupBy(shorter(F.col("h")).alias("h"), "w").agg(F.sum("r").alias("r")), f"counts{k}")
    unigrams = save(counts[2].groupBy("w").agg(F.sum("r").alias("c")), "word_counts")
    total = unigrams.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    n, v = int(total[0]), int(total[1])
    unigrams = unigrams.withColumn("p", (F.col("c") + ADD) / F.lit(n + ADD * (v + 1)))
    tables, weights = {}, {}
    for k in range(2, order + 1):
        found = {r.r: r.n for r in counts[k].where(F.col("r") <= TOP + 1).groupBy("r").agg(F.count(F.lit(1)).alias("n")).collect()}
        d = F.coalesce(*(F.when(F.col("r") == r, F.lit(x)) for r, x in discounts(found).items()), F.lit(1.0))
        if k == 2:
            full = counts[k].join(unigrams.select("w", F.col("p").alias("p1"), F.col("p").alias("below")), "w")
        else:
            below = tables[k - 1].select(F.col("h").alias("h2"), "w", "p1", F.pow(F.lit(10.0), "logp").alias("below"))
            full = counts[k].withColumn("h2", shorter(F.col("h"))).join(below, ["h2", "w"]).drop("h2")
        full = full.withColumn("kept", d * F.col("r"))
        by_h = full.groupBy("h").agg(F.sum("r").alias("c_h"), F.sum("kept").alias("kept_h"), F.sum("below").alias("p_h"))
        by_h = by_h.withColumn("s", F.when(F.col("kept_h") > F.col("c_h") - 1e-9, F.col("c_h") / (F.col("c_h") + 1)).otherwise(1.0))
        by_h = save(by_h.withColumn("a", (1 - F.col("s") * F.col("kept_h") / F.col("c_h")) / (1 - F.col("p_h"))), f"weights{k}")
        tables[k] = save(full.join(by_h, "h").select("h", "w", F.log10(F.col("s") * F.col("kept") / F.col("c_h")).alias("logp"), "p1"), f"grams{k}")
        weights[k] = by_h.select("h", "a")
    return Model(unigrams, tables, weights, n, v)


def score(docs: DataFrame, model: Model, known: Column | None = None) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) for each row of docs (doc_id, text): log10 probabilities of whole texts.

    base_score is the sum of log10 P_1(w). `known` says of which rows the model was trained, whose grams it has all
    seen. What is not found at one order takes the weight of its history, if that was seen, and is looked up at the
    next lower one, down to single words. Null texts are empty: one token, the end. Rows alike in doc_id and text are
    scored together and each told; a doc_id may be null or repeated.
    """
    known = F.lit(False) if known is None else known
    docs = docs.select("doc_id", "text", known.alias("known")).withColumn("key", F.xxhash64("doc_id", F.coalesce("text", F.lit("")), "known"))
    once = docs.dropDuplicates(["key"])
    left = once.select("key", "known", F.explode(grams(words(F.col("text")), model.order)).alias("t")).select("key", "known", "t.h", "t.w", F.lit(0.0).alias("so_far"))
    done = []
    for k in range(model.order, 1, -1):
        found = left.join(model.grams[k], ["h", "w"])
        done.append(found.select("key", F.lit(1).alias("n"), F.log10("p1").alias("base"), (F.col("so_far") + F.col("logp")).alias("logp")))
        left = left.where("not known").join(model.grams[k], ["h", "w"], "left_anti").join(model.weights[k], "h", "left")
        left = left.select("key", "known", shorter(F.col("h")).alias("h"), "w", (F.col("so_far") + F.log10(F.coalesce("a", F.lit(1.0)))).alias("so_far"))
        left = save(left, f"unseen{k}")
    p = F.coalesce("p", F.lit(model.unseen))
    done.append(left.join(model.unigrams, "w", "left").select("key", F.when(F.col("p").isNotNull(), 1).otherwise(0).alias("n"), F.log10(p).alias("base"), (F.col("so_far") + F.log10(p)).alias("logp")))
    sums = functools.reduce(DataFrame.union, done).groupBy("key").agg(F.sum("n").alias("n_known"), F.sum("base").alias("base_score"), F.sum("logp").alias("score"))
    rows = docs.select("doc_id", "key", (F.size(words(F.col("text"))) + 1).cast("long").alias("n_tokens"))
    return rows.join(sums, "key").select("doc_id", "n_tokens", F.col("n_known").cast("long").alias("n_known"), "base_score", "score")
