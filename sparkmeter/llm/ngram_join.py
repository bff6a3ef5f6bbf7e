"""Set-similarity join of word shingles with PartEnum signatures, and the classes that its links form.

Sets are put into bands of nearly equal size. Two similar sets of one band, or of neighbouring ones, differ in at
most k features. The features are dealt by hash into n1 partitions of three cells each; with n1 > k / 2, one
partition holds at most one difference, so one pair of its cells is equal in both sets. Each pair of cells of each
partition is a signature, so similar sets always share one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import prepare
from .components import components
from .shared import batches_of, save
from .words import chunks, lists, longs, mix, shingles, words

CELLS = 3
PAIRS = ((0, 1), (0, 2), (1, 2))
SKETCH = 32  # longs of parity bits: enough to tell long texts apart too
NARROW = 8  # longs of the same bits folded, for a first look at many pairs
#: Sets of more shingles have a wide sketch too, of one bit a shingle or more: SKETCH longs fill up and rule nothing out.
WIDE = 32 * SKETCH
#: Of a signature 40 bits are kept, which take less room; what then shares one by chance is ruled out with the other pairs.
SIG = ~np.uint64(0xFFFFFF)
#: A signature with more than this share of all rows is dealt over SALTS tasks.
HOT_SHARE, SALTS, LOOK = 0.001, 64, 0.02
#: Three longs a row: about 50 MB in memory.
BROADCAST_ROWS = 1_000_000
_SET = "key1 long, key2 long, n_shingles long, " + ", ".join(f"p{i} long" for i in range(SKETCH))


def bands(top: int, num: int, den: int) -> np.ndarray:
    """Largest size of each band; sets similar to one of band i lie in the bands i-1 to i+1."""
    ends, low = [], 1
    while not ends or ends[-1] < top:
        ends.append(low * den // num)
        low = ends[-1] + 1
    return np.array(ends)


def signatures(h: np.ndarray, owner: np.ndarray, sizes: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(signatures of all sets in order, their number by set), each set as a member of its own band and of the next."""
    ends = bands(int(sizes.max(initial=1)), num, den)
    ends = np.append(ends, (ends[-1] + 1) * den // num)
    own = np.searchsorted(ends, np.maximum(sizes, 1))
    found, place, element = [], [], mix(h ^ np.uint64(0xA5A5A5A55A5A5A5A))
    for step in (0, 1):
        band = own + step
        differ = 2 * ends[band] * (den - num) // (den + num)
        parts = np.where(sizes > 0, differ // 2 + 1, 0)
        first = (np.cumsum(parts) - parts) * CELLS
        cells = np.zeros(int(parts.sum()) * CELLS, np.uint64)
        turn = mix(h + band[owner].astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))
        cell = ((turn >> np.uint64(32)) % (parts[owner] * CELLS).astype(np.uint64)).astype(np.int64)
        cell[differ[owner] == 0] = 0  # no difference allowed: the whole set is one signature
        np.add.at(cells, first[owner] + cell, element)
        set_of = np.repeat(np.arange(len(sizes)), parts)
        part = np.arange(len(set_of)) - np.repeat(np.cumsum(parts) - parts, parts)
        tag = mix(band[set_of].astype(np.uint64) << np.uint64(32) | part.astype(np.uint64))
        cells = cells.reshape(-1, CELLS)
        for p, (a, b) in enumerate(PAIRS):
            keep = np.flatnonzero((differ[set_of] > 0) | (p == 0))
            found.append(mix(mix(cells[keep, a] + tag[keep]) * np.uint64(3) + mix(cells[keep, b] ^ np.uint64(p + 1)) + tag[keep]))
            place.append(set_of[keep])
    place = np.concatenate(place)
    return np.concatenate(found)[np.argsort(place, kind="stable")] & SIG, np.bincount(place, minlength=len(sizes))


def _described(h: np.ndarray, owner: np.ndarray, n: int) -> list[np.ndarray]:
    """Two independent sums over each set, its size, and its parity bits: features by hash, even or odd count."""
    a, b, bits = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros((n, SKETCH), np.uint64)
    np.add.at(a, owner, mix(h))
    np.add.at(b, owner, mix(h ^ np.uint64(0x5DEECE66D)))
    bit = mix(h + np.uint64(77)) % np.uint64(64 * SKETCH)
    np.bitwise_xor.at(bits, (owner, (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
    return [mix(a), b, np.bincount(owner, minlength=n), *bits.T.copy()]


def _wide(h: np.ndarray, owner: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Parity bits of each set of more than WIDE shingles, as many as the next power of two; nothing for smaller ones."""
    width = np.where(sizes > WIDE, 1 << np.ceil(np.log2(np.maximum(sizes, 64))).astype(np.int64), 0) >> 6
    at = np.append(0, np.cumsum(width))
    bits, keep = np.zeros(at[-1], np.uint64), width[owner] > 0
    bit, of = mix(h[keep] + np.uint64(78)) % (width[owner[keep]].astype(np.uint64) * np.uint64(64)), owner[keep]
    np.bitwise_xor.at(bits, at[of] + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer((at * 8).astype(np.int32)), pa.py_buffer(bits)])


def _least_difference(x: bytes, y: bytes) -> int:
    """At least in so many features two sets differ, by wide sketches; the longer one is folded, as both have a power of two of bits."""
    a, b = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
    return int(np.bitwise_count(a ^ np.bitwise_xor.reduce(b.reshape(-1, len(a)), 0)).sum()) if len(a) else 0


def _not_apart(num: int, den: int):
    """Of (a, b, x, y, n) the pairs (a, b) whose wide sketches x and y don't rule a link out; n is the sum of both sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            differ = np.fromiter(map(_least_difference, rows.column(2).to_pylist(), rows.column(3).to_pylist()), np.int64, rows.num_rows)
            yield rows.select(["a", "b"]).filter(pa.array((den - num) * rows.column(4).to_numpy() >= (den + num) * differ))

    return run


def _sets(k: int, num: int, den: int, what: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in chunks(batches):
            n = rows.num_rows
            h, owner = shingles(*words(data, at)[:2], n, k)
            about = _described(h, owner, n)
            if what == "about":
                yield pa.RecordBatch.from_arrays([rows.column(0), *map(longs, about), _wide(h, owner, about[2])], ["doc_id", *(x.split()[0] for x in _SET.split(", ")), "wide"])
            else:
                more = lists(*signatures(h, owner, about[2], num, den)) if what == "signatures" else rows.column(1)
                yield pa.RecordBatch.from_arrays([rows.column(0), *map(longs, about[:2]), more], ["doc_id", "key1", "key2", what])

    return run


def _linked(k: int, num: int, den: int):
    """Of (a, b, x, y) the pairs (a, b) whose texts x and y have similar sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in chunks(batches, "x"):
            n = rows.num_rows
            h, owner = shingles(*words(data, at)[:2], n, k)
            parts = [shingles(*words(*other)[:2], m.num_rows, k) for m, *other in chunks(iter([rows]), "y", 1 << 62)]
            g, of = (np.concatenate(x) for x in zip(*parts))
            both, whose = np.concatenate([h, g]), np.concatenate([owner, of])
            order = np.lexsort((both, whose))
            both, whose = both[order], whose[order]
            twice = (both[1:] == both[:-1]) & (whose[1:] == whose[:-1])
            inter = np.bincount(whose[1:][twice], minlength=n)
            union = np.bincount(whose, minlength=n) - inter
            yield rows.select(["a", "b"]).filter(pa.array(den * inter >= num * union))

    return run


def _similar(a: str, b: str, differ: Column, num: int, den: int) -> Column:
    """|x & y| / |x | y| >= num / den, said of the number of features in which they differ."""
    return (den - num) * (F.col(f"{a}.n_shingles") + F.col(f"{b}.n_shingles")) >= (den + num) * differ


def _folded() -> list[Column]:
    """q0, q1, ...: parity bits over NARROW longs."""
    out = []
    for i in range(NARROW):
        bits = F.col(f"p{i}")
        for j in range(i + NARROW, SKETCH, NARROW):
            bits = bits.bitwiseXOR(F.col(f"p{j}"))
        out.append(bits.alias(f"q{i}"))
    return out


def _could(a: str, b: str, num: int, den: int, bits: str = "p") -> Column:
    """Never false of a link: sets differ in at least as many features as their parity bits differ."""
    odd = sum((F.bit_count(F.col(f"{a}.{bits}{i}").bitwiseXOR(F.col(f"{b}.{bits}{i}"))) for i in range(SKETCH if bits == "p" else NARROW)), F.lit(0))
    small, large = F.least(f"{a}.n_shingles", f"{b}.n_shingles"), F.greatest(f"{a}.n_shingles", f"{b}.n_shingles")
    return (small * den >= large * num) & _similar(a, b, odd, num, den)


def link_classes(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """`doc_id, n_shingles, component_id` for every row of docs (doc_id, text).

    Documents link when their sets of k-word shingles have a Jaccard similarity of num / den at least.
    component_id is the smallest doc_id reachable by links. Null and empty texts have no shingles and are linked
    with nothing. Rows that repeat a doc_id are documents of their own. A class without any doc_id has a null
    component_id. Columns beside doc_id and text are not looked at.

    Equal sets become one node first. In each bucket of a signature the nodes are compared with the bucket's
    smallest node only, and only with one of them where that is enough; once linked nodes are one component, what remains to compare are nodes of one bucket in
    different components, and of these the pairs whose parity bits don't rule a link out. Every pair is checked on
    the real sets. So a group of copies costs its size, not its square, and no link between components is lost.
    """
    prepare(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    every = save(docs.mapInArrow(_sets(k, num, den, "about"), f"doc_id long, {_SET}, wide binary"), "sets")
    signed = lambda some: some.mapInArrow(_sets(k, num, den, "signatures"), "doc_id long, key1 long, key2 long, signatures array<long>")  # noqa: E731  made where they are exploded, never stored
    sets = every.where("n_shingles > 0")
    about = ["n_shingles", *(f"p{i}" for i in range(SKETCH)), "wide"]
    nodes = sets.groupBy("key1", "key2").agg(F.min("doc_id").alias("doc_id"), *(F.first(c).alias(c) for c in about))
    # a node is named by its smallest doc_id, or by its key where that is null or shared with another set
    shared = nodes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null or doc_id < 0").select(F.col("doc_id").alias("odd"))
    nodes = nodes.join(shared, F.col("doc_id").eqNullSafe(F.col("odd")), "left").withColumn("odd", F.col("odd").isNotNull() | F.col("doc_id").isNull() | (F.col("doc_id") < 0))
    nodes = save(nodes.withColumn("node", F.when(F.col("odd"), -1 - F.col("key1").bitwiseAND(F.lit((1 << 62) - 1))).otherwise(F.col("doc_id"))).drop("odd"), "nodes")
    copies = sets.select("key1", "key2", F.col("doc_id").alias("other")).join(nodes.select("key1", "key2", "doc_id", "node"), ["key1", "key2"])

    # one row for each node: copies beside the named one go, by a broadcast while they are few
    others = save(copies.where(~F.col("other").eqNullSafe(F.col("doc_id")) | (F.col("node") < 0)).select("key1", "key2", F.col("other").alias("doc_id")), "copies")
    few = F.broadcast(others) if others.count() <= BROADCAST_ROWS else others
    all_signed = signed(docs)
    alone = all_signed.join(few, (all_signed.doc_id.eqNullSafe(others.doc_id)) & (all_signed.key1 == others.key1) & (all_signed.key2 == others.key2), "left_anti")
    rows = alone.select(F.explode("signatures").alias("sig"), F.col("doc_id").alias("node"))
    odd_nodes = save(nodes.where("node < 0").select("key1", "key2", "node"), "odd_nodes")
    has_odd = not odd_nodes.isEmpty()
    if has_odd:
        odd = odd_nodes.join(signed(docs), ["key1", "key2"]).groupBy("node").agg(F.first("signatures").alias("signatures"))
        rows = rows.union(odd.select(F.explode("signatures").alias("sig"), "node"))

    seen = signed(docs.sample(LOOK, seed=1)).dropDuplicates(["key1", "key2"]).select(F.explode("signatures").alias("sig"))
    look = save(seen.groupBy("sig").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "look")
    total = look.agg(F.sum("n")).first()[0] or 0
    hot = [r.sig for r in look.where(F.col("n") > max(20, HOT_SHARE * total)).select("sig").limit(int(1 / HOT_SHARE)).collect()]
    salt = F.when(F.col("sig").isin(hot), F.pmod(F.xxhash64("node"), F.lit(SALTS))).otherwise(0) if hot else F.lit(0)
    by = Window.partitionBy("sig", "salt")
    rows = rows.withColumn("salt", salt).withColumn("hub", F.min("node").over(by)).withColumn("top", F.max("node").over(by))
    met = F.col("hub") != F.col("top")
    buckets = save(rows.where(met | F.col("sig").isin(hot) if hot else met).select("sig", "node", "hub"), "buckets")

    narrow = nodes.select("node", "n_shingles", *_folded())

    def looked_at(pairs: DataFrame) -> DataFrame:
        """Those pairs (a, b) that the folded bits don't rule out."""
        x, y = narrow.alias("x"), narrow.alias("y")
        return pairs.join(x, F.col("a") == F.col("x.node")).join(y, F.col("b") == F.col("y.node")).where(_could("x", "y", num, den, "q")).select("a", "b")

    def check(pairs: DataFrame) -> DataFrame:
        """The links among pairs (a, b), by their parity bits and then their real sets, made from their texts, which take less room than the sets."""
        flat = nodes.drop("wide")
        x, y = flat.alias("x"), flat.alias("y")
        pairs = pairs.join(x, F.col("a") == F.col("x.node")).join(y, F.col("b") == F.col("y.node")).where(_could("x", "y", num, den))
        pairs = save(pairs.select("a", "b", (F.col("x.n_shingles") + F.col("y.n_shingles")).alias("n"), (F.least("x.n_shingles", "y.n_shingles") > WIDE).alias("large")), "close_pairs")
        sketch = nodes.where(F.col("n_shingles") > WIDE)
        x, y = (sketch.select(F.col("node").alias(c), F.col("wide").alias(w)) for c, w in (("a", "x"), ("b", "y")))
        large = pairs.where("large").join(x, "a").join(y, "b").select("a", "b", "x", "y", "n")
        with batches_of(docs.sparkSession, 1000):
            pairs = save(pairs.where("not large").select("a", "b").union(large.mapInArrow(_not_apart(num, den), "a long, b long")), "pairs")
        ends = save(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes, "node").select("node", "key1", "key2", F.col("doc_id").alias("of")), "ends")
        fit = F.broadcast if ends.count() <= BROADCAST_ROWS else lambda x: x
        some = docs.join(fit(ends.select("of").distinct()), F.col("doc_id").eqNullSafe(F.col("of"))).select("doc_id", "text")
        keyed = some.mapInArrow(_sets(k, num, den, "text"), "doc_id long, key1 long, key2 long, text string")
        texts = keyed.join(fit(ends), ["key1", "key2"]).where(F.col("doc_id").eqNullSafe(F.col("of"))).select("node", "text")
        if has_odd:  # only rows without an id of their own can come more than once
            texts = texts.groupBy("node").agg(F.first("text").alias("text"))
        with batches_of(docs.sparkSession, 1000):
            texts = save(texts, "texts")
        both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
        with batches_of(docs.sparkSession, 500):
            return save(both.select("a", "b", "x", "y").mapInArrow(_linked(k, num, den), "a long, b long"), "links")

    hubs = buckets.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    if hot:
        heads = buckets.where(F.col("sig").isin(hot)).groupBy("sig").agg(F.min("hub").alias("head"))
        hubs = hubs.union(buckets.select("sig", "hub").distinct().join(heads, "sig").where("hub <> head").select("hub", "head"))
    # first each node with the hub it shares most signatures with, then the other hubs, if not in its component by then
    hubs = save(hubs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")), "hub_pairs")
    links = check(looked_at(hubs.groupBy("a").agg(F.max_by("b", F.struct("n", "b")).alias("b"))))
    roots = components(links)
    left, right = (roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab")
    apart = hubs.join(left, "a", "left").join(right, "b", "left").where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b"))
    links = links.union(check(looked_at(apart.select("a", "b"))))
    roots = components(links)

    placed = buckets.select("sig", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_ = placed.groupBy("sig").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("sig")
    rest = save(placed.join(open_, "sig"), "open_buckets").join(narrow, "node")
    x, y = rest.alias("x"), rest.alias("y")
    across = (F.col("x.sig") == F.col("y.sig")) & (F.col("x.node") > F.col("y.node")) & (F.col("x.root") != F.col("y.root")) & _could("x", "y", num, den, "q")
    more = x.join(y, across).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct().join(hubs.select("a", "b"), ["a", "b"], "left_anti")
    roots = components(links.union(check(more)))

    classes = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = classes.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = classes.select("key1", "key2", "root").join(least, "root").select("key1", "key2", "component_id")
    return every.select("doc_id", "key1", "key2", "n_shingles").join(named, ["key1", "key2"], "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
