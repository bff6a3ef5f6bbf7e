"""Online context policies replayed in closed form over reference gaps, and the backtest around them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import scale
from ..functions.digests import sorted_digest
from ..functions.numbers import length_bucket, percent, split_of, wilson
from .bound import PINNED, SEG, with_gaps

# --- fixed values: the registered protocol ----------------------------------------------------
FAMILIES = ("window", "recency", "pointer")
GRID = (1, 2, 4, 8, 16, 32)
PENALTY = 1_000.0
STUB = 20.0
MIN_CALLS = 3
DEFAULT_N = 8
MIN_DEV = 5
MAX_MISS_RATE = 5.0
MIN_CELL = 10
BOOTSTRAP = 10_000
SEED = 20261005
# ------------------------------------------------------------------------------------------------


def simulate(needs: DataFrame, refs: DataFrame, calls: DataFrame, grid: Sequence[int] = GRID, penalty: float = PENALTY,
             stub: float = STUB) -> DataFrame:
    """(session_id, family, n, cost, measured, refs, misses, saved_pct, miss_rate).

    Every policy pays for the base, for pinned segments and for each segment at birth. Then, per gap
    g between needs: recency keeps min(g-1, N) idle calls and misses when g > N; pointer adds a stub
    for each idle call not kept; window keeps the first N calls and misses every use after them.
    One conditional aggregation over gaps and one over segments serve the whole grid.
    """
    g = with_gaps(refs)
    born = g.where("gap IS NULL").select(*SEG, F.col("k").alias("birth"))
    g = g.where("gap IS NOT NULL").join(born, SEG)
    n, idle = F.col("tokens"), F.col("gap") - 1
    per_gap = [F.count(F.lit(1)).alias("refs"), F.sum(n).alias("_used")]
    for N in grid:
        kept = F.least(idle, F.lit(N))
        late = (F.col("k") - F.col("birth")) >= N
        per_gap += [
            F.sum(n * kept).alias(f"_rk{N}"), F.count(F.when(F.col("gap") > N, 1)).alias(f"_rm{N}"),
            F.sum((idle - kept) * F.least(F.lit(stub), n)).alias(f"_rs{N}"),
            F.count(F.when(late, 1)).alias(f"_wm{N}"), F.sum(F.when(late, n)).alias(f"_wn{N}")]
    gaps = g.groupBy("session_id").agg(*per_gap)
    s = needs.where(F.col("end") > F.col("birth"))
    free = F.col("kind") != PINNED
    span, tail = F.col("end") - F.col("birth"), F.col("end") - 1 - F.col("last")
    per_seg = [F.sum("resident").alias("_res"), F.sum(F.when(~free, F.col("resident"))).alias("_pin"), F.sum(F.when(free, n)).alias("_born")]
    for N in grid:
        kept = F.least(tail, F.lit(N))
        per_seg += [F.sum(F.when(free, n * F.least(span, F.lit(N)))).alias(f"_wk{N}"), F.sum(F.when(free, n * kept)).alias(f"_tk{N}"),
                    F.sum(F.when(free, (tail - kept) * F.least(F.lit(stub), n))).alias(f"_ts{N}")]
    segs = s.groupBy("session_id").agg(*per_seg)
    m = calls.groupBy("session_id").agg(F.sum("context").alias("measured"), F.count(F.lit(1)).alias("calls"))
    t = m.join(segs, "session_id", "left").join(gaps, "session_id", "left").fillna(0)
    base = F.col("measured") - F.col("_res") + F.col("_pin")
    cells = []
    for N in grid:
        recency = base + F.col("_born") + F.col("_used") + F.col(f"_rk{N}") + F.col(f"_rm{N}") * penalty + F.col(f"_tk{N}")
        cost = {
            "window": (base + F.col(f"_wk{N}") + F.col(f"_wn{N}") + F.col(f"_wm{N}") * penalty, F.col(f"_wm{N}")),
            "recency": (recency, F.col(f"_rm{N}")),
            "pointer": (recency + F.col(f"_rs{N}") + F.col(f"_ts{N}"), F.col(f"_rm{N}")),
        }
        cells += [F.struct(F.lit(f).alias("family"), F.lit(N).cast("bigint").alias("n"), cost[f][0].alias("cost"), cost[f][1].alias("misses")) for f in FAMILIES]
    rows = t.select("session_id", "calls", "measured", "refs", F.inline(F.array(*cells)))
    return rows.withColumns({"saved_pct": percent(F.col("measured") - F.col("cost"), "measured"), "miss_rate": percent("misses", "refs")})


def full_policy(needs: DataFrame, calls: DataFrame) -> DataFrame:
    """Keeping everything costs what was measured."""
    s = needs.groupBy("session_id").agg(F.sum("resident").alias("resident"), F.sum(F.when(F.col("kind") != PINNED, F.greatest(F.lit(0), F.coalesce("m", F.lit(0)) - 1))).alias("refs"))
    m = calls.groupBy("session_id").agg(F.sum("context").alias("measured"))
    return m.join(s, "session_id").select("session_id", "measured", "refs", F.col("measured").cast("double").alias("cost"))


def backtest_rows(policies: DataFrame, bounds: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """Long rows of sessions with enough calls: policy results, gap closed, bucket, split, source.
    fingerprints: (session_id, fingerprint, source). bounds needs P0, P1000 and Pinf."""
    b = bounds.select("session_id", F.col("avoidable_pct_P0").alias("p0"), F.col("avoidable_pct_Pinf").alias("pinf"),
                      F.col("avoidable_pct_P1000").alias("oracle"))
    r = policies.where(F.col("calls") >= MIN_CALLS).join(b, "session_id").join(fingerprints, "session_id")
    return r.withColumns({"gap_closed_pct": F.when(F.col("oracle") > 0, 100 * F.col("saved_pct") / F.col("oracle")),
                          "bucket": length_bucket("calls"), "split": split_of("fingerprint")})


def exclusions(calls: DataFrame) -> DataFrame:
    n = calls.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.count(F.lit(1)).alias("loaded"), F.count(F.when(F.col("n") < MIN_CALLS, 1)).alias("excluded_short"),
                 F.count(F.when(F.col("n") >= MIN_CALLS, 1)).alias("kept"))


def tune(rows: DataFrame) -> DataFrame:
    """(family, n): on the dev split, the N with the largest median saving whose median miss rate is
    acceptable; the smaller N on ties; the default with too few dev sessions; else the largest N."""
    dev = rows.where("split = 'dev'")
    med = scale.exact_medians(dev, ["family", "n"], saved="saved_pct", miss="miss_rate")
    best = med.where(F.col("miss") <= MAX_MISS_RATE).groupBy("family").agg(F.max_by("n", F.struct("saved", -F.col("n"))).alias("_n"))
    count = dev.groupBy("family").agg(F.count_distinct("session_id").alias("dev_sessions"))
    out = rows.select("family").distinct().join(count, "family", "left").join(best, "family", "left")
    n = F.when(F.coalesce("dev_sessions", F.lit(0)) < MIN_DEV, F.lit(DEFAULT_N)).otherwise(F.coalesce("_n", F.lit(GRID[-1])))
    return out.select("family", F.coalesce("dev_sessions", F.lit(0)).alias("dev_sessions"), n.cast("bigint").alias("n"))


STRATA = [[], ["split"], ["source"], ["bucket"], ["source", "bucket"]]


def in_strata(rows: DataFrame) -> DataFrame:
    """One row per stratum a row belongs to: stratum kind and label."""
    kinds = {"all": F.lit("all"), "test": F.when(F.col("split") == "test", "test"), "source": F.col("source"), "length": F.col("bucket"),
             "source_length": F.concat_ws("|", "source", "bucket")}
    s = F.array(*[F.struct(F.lit(k).alias("stratum"), c.alias("label")) for k, c in kinds.items()])
    return rows.select("*", F.inline(s)).where("label IS NOT NULL")


def strata(rows: DataFrame, value: str) -> DataFrame:
    """n, quartiles and a small-sample flag of a per-session value in every stratum."""
    long = in_strata(rows)
    n = long.groupBy("stratum", "label").agg(F.count(F.lit(1)).alias("sessions"))
    q = scale.exact_percentiles(long, ["stratum", "label"], value, q1=0.25, median=0.5, q3=0.75)
    return n.join(q, ["stratum", "label"]).withColumn("insufficient", F.col("sessions") < MIN_CELL)


# ---------------------------------------------------------------- bootstrap


def bootstrap_median(df: DataFrame, by: list[str], value: str, reps: int = BOOTSTRAP, seed: int = SEED, alpha: float = 0.05) -> DataFrame:
    """Percentile interval of the median over resamples of the sessions.

    The median of n draws with replacement is an order statistic of n uniforms pushed through the
    sorted values, and that order statistic has a Beta law. So each resample costs one or two draws
    instead of n, whatever n is. Draws are seeded per (group, rep): the same on any partitioning.
    """
    ranks = scale.materialize(scale.value_ranks(df, by, value))  # read for the sizes and for the look-up
    totals = ranks.groupBy(*by).agg(F.first("total").alias("total")) if by else ranks.agg(F.first("total").alias("total"))
    tasks = totals.where("total >= 2").select(*by, "total", F.xxhash64(F.lit(seed), *by).alias("_h"), F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))

    @F.pandas_udf("struct<i:bigint,j:bigint>")
    def middle(h: pd.Series, rep: pd.Series, total: pd.Series) -> pd.DataFrame:
        out = np.empty((len(h), 2), dtype=np.int64)
        for at, (a, r, n) in enumerate(zip(h, rep, total)):
            rng = np.random.Generator(np.random.Philox(key=[int(a) & (2**64 - 1), int(r)]))
            m = (n + 1) // 2
            u = rng.beta(m, n - m + 1)
            v = u if n % 2 else u + (1 - u) * (1 - rng.random() ** (1.0 / (n - m)))
            out[at] = min(int(u * n), n - 1), min(int(v * n), n - 1)
        return pd.DataFrame({"i": out[:, 0], "j": out[:, 1]})

    drawn = tasks.withColumn("_d", middle("_h", "rep", "total"))
    asks = drawn.select(*by, "rep", F.explode(F.array(F.col("_d.i"), F.col("_d.j"))).alias("rank"))
    asks = asks.groupBy(*by, "rank", "rep").agg(F.count(F.lit(1)).alias("weight"))
    # rank -> value: merge the asked ranks with the run starts and take the latest start
    line = ranks.select(*by, F.col("before").alias("rank"), F.lit(None).cast("int").alias("rep"), F.lit(None).cast("bigint").alias("weight"), F.col(value).cast("double").alias("_v"))
    line = line.unionByName(asks.withColumn("_v", F.lit(None).cast("double")))
    line = line.withColumn(scale.BLOCK, F.floor(F.log2(F.col("rank") + 1.0) * 64).cast("int")).withColumn("_o", F.coalesce(F.col("rep"), F.lit(-1)))
    found = scale.scan(line, by, ["rank", "_o"], _val=scale.last_known(F.col("_v"))).where("rep IS NOT NULL")
    med = found.groupBy(*by, "rep").agg((F.sum(F.col("_val") * F.col("weight")) / 2).alias("_m"))
    w = Window.partitionBy(*by).orderBy("_m", "rep")  # one row per resample: bounded by reps
    med = med.withColumn("_r", F.row_number().over(w) - 1)
    low, high = int(alpha / 2 * reps), min(reps - 1, int((1 - alpha / 2) * reps))
    return med.groupBy(*by).agg(F.max(F.when(F.col("_r") == low, F.col("_m"))).alias("ci_low"), F.max(F.when(F.col("_r") == high, F.col("_m"))).alias("ci_high"))


def hash_index(n: Column, *parts) -> Column:
    """Draw in [0, n): a hash of its coordinates, independent of partitioning."""
    return F.pmod(F.xxhash64(*parts), n)


def bootstrap_ratio(instr: DataFrame, reps: int = 2000, seed: int = 20261006, ci: float = 0.90, unit: str = "session") -> DataFrame:
    """Interval of median(after) / median(before), whole sessions resampled on each side.

    instr: (side, session_id, input). Each rep draws as many clusters as a side has; the draws are
    counted per cluster, so a cluster drawn twice is one row of weight two. Work grows with
    clusters x reps: it is meant for study-sized inputs.
    """
    if unit not in ("session", "instruction"):
        raise ValueError(unit)
    key = F.col("session_id") if unit == "session" else F.monotonically_increasing_id()
    rows = instr.select("side", key.alias("cluster"), "input")
    hist = rows.groupBy("side", "cluster", "input").agg(F.count(F.lit(1)).alias("n"))
    ids = hist.select("side", "cluster").distinct()
    ids = scale.scan(ids.withColumn(scale.BLOCK, F.pmod(F.xxhash64("cluster"), F.lit(256))), ["side"], ["cluster"], idx=scale.row_index()).drop(scale.BLOCK)
    size = ids.groupBy("side").agg(F.count(F.lit(1)).alias("size"))
    draws = ids.join(size, "side").select("side", "size", F.col("idx").alias("draw"), F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    draws = draws.withColumn("idx", hash_index(F.col("size"), F.lit(seed), "side", "rep", "draw"))
    weights = draws.groupBy("side", "rep", "idx").agg(F.count(F.lit(1)).alias("w")).join(ids, ["side", "idx"])
    pooled = weights.join(hist, ["side", "cluster"]).groupBy("side", "rep", "input").agg(F.sum(F.col("w") * F.col("n")).alias("n"))
    med = _weighted_median(pooled, ["side", "rep"], "input", "n")
    r = med.groupBy("rep").agg(F.max(F.when(F.col("side") == "before", F.col("median"))).alias("b"), F.max(F.when(F.col("side") == "after", F.col("median"))).alias("a"))
    r = r.withColumn("ratio", F.try_divide("a", "b")).where("ratio IS NOT NULL")
    tail = (1 - ci) / 2
    return r.agg(F.percentile("ratio", F.lit(tail)).alias("ci_low"), F.percentile("ratio", F.lit(1 - tail)).alias("ci_high"), F.count(F.lit(1)).alias("reps"))


def _weighted_median(df: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    v = F.col(value).cast("double")
    df = df.withColumn(scale.BLOCK, F.floor(F.signum(v) * F.log2(F.abs(v) + 1) * 4).cast("int"))
    r = scale.scan(df, by, [value], before=scale.running_sum(F.col(weight), inclusive=False))
    t = df.groupBy(*by).agg(F.sum(weight).alias("total"))
    r = r.join(t, by)
    lo, hi = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)

    def at(rank):
        return F.max(F.when((rank >= F.col("before")) & (rank < F.col("before") + F.col(weight)), v))

    return r.groupBy(*by).agg(((at(lo) + at(hi)) / 2).alias("median"))


# ---------------------------------------------------------------- detector validation


def _permuted(number: Column, half_bits: int, seed: int) -> Column:
    """A bijection of 0 .. 4**half_bits - 1 that looks random: four Feistel rounds."""
    mask = F.lit((1 << half_bits) - 1)
    left, right = F.shiftrightunsigned(number, half_bits), number.bitwiseAND(mask)
    for turn in range(4):
        left, right = right, left.bitwiseXOR(F.xxhash64(F.lit(seed), F.lit(turn), right).bitwiseAND(mask))
    return F.shiftleft(left, half_bits).bitwiseOR(right)


def validation_pairs(wins: DataFrame, refs: DataFrame, fingerprints: DataFrame, n: int, seed: int = 7) -> DataFrame:
    """A blind sample of (segment, later call) pairs, half detected as a use and half not, hash-ordered.

    Detected pairs are the refs. For the undetected ones pair numbers are drawn in a seeded order without
    repeats and located by prefix sums over the segments' window lengths, so windows are never expanded; more
    are drawn until that half is full or no pair is left.
    """
    fp = fingerprints.select("session_id", "fingerprint")
    live = wins.where((F.col("kind") != PINNED) & (F.col("end") > F.col("birth") + 1)).select(*SEG, "birth", "end")
    live = live.withColumn("w", F.col("end") - F.col("birth") - 1)
    hits = refs.join(live.select(*SEG, "birth"), SEG).where("k > birth").select(*SEG, "k")
    total = live.agg(F.sum("w").alias("t")).first()["t"] or 0
    half_bits = max(1, (int(total).bit_length() + 1) // 2)
    domain = 1 << (2 * half_bits)
    cut = live.withColumn(scale.BLOCK, F.pmod(F.xxhash64(*SEG), F.lit(4096)))
    starts = scale.scan(cut, [], SEG, at=scale.running_sum(F.col("w"), inclusive=False))
    line = starts.select("at", F.lit(0).alias("ask"), F.struct(*SEG, "birth", "at").alias("seg"))
    drawn = min(domain, 8 * n + 64)
    while True:
        draws = wins.sparkSession.range(drawn).select(_permuted(F.col("id"), half_bits, seed).alias("at")).where(F.col("at") < total)
        asked = line.unionByName(draws.select("at", F.lit(1).alias("ask"), F.lit(None).cast(line.schema["seg"].dataType).alias("seg")))
        asked = asked.withColumn(scale.BLOCK, F.floor(F.col("at") / F.lit(max(1, total // 4096))))
        found = scale.scan(asked, [], ["at", "ask"], own=scale.last_known(F.col("seg"))).where("ask = 1")
        offered = found.select("own.session_id", "own.seg_id", (F.col("own.birth") + 1 + F.col("at") - F.col("own.at")).alias("k"))
        missed = offered.join(hits, [*SEG, "k"], "left_anti")
        if drawn == domain or missed.join(fp, "session_id", "left_semi").limit(n - n // 2).count() == n - n // 2:
            break
        drawn = min(domain, 8 * drawn)
    pairs = hits.withColumn("stratum", F.lit("hit")).unionByName(missed.withColumn("stratum", F.lit("miss"))).join(fp, "session_id")
    key = F.substring(F.sha2(F.concat_ws("|", "fingerprint", "seg_id", "k"), 256), 1, 16)
    pairs = pairs.select(*SEG, "k", key.alias("key"), "stratum")
    pairs = pairs.withColumn("shuffle", F.sha2(F.concat(F.lit(f"{seed}|"), "key"), 256))
    w = Window.partitionBy("stratum").orderBy("shuffle", "key")  # rank <= half is pushed below the shuffle
    half = max(n // 2, n - n // 2)
    pairs = pairs.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= half)
    return pairs.where(F.col("_r") <= F.when(F.col("stratum") == "hit", n // 2).otherwise(n - n // 2)).drop("_r")


def detector_quality(answers: DataFrame, population: DataFrame) -> DataFrame:
    """answers: (stratum, needed). population: (stratum, size). Precision, miss rate (Wilson), recall."""
    a = answers.agg(
        F.count(F.when(F.col("stratum") == "hit", 1)).alias("detected"), F.count(F.when((F.col("stratum") == "hit") & F.col("needed"), 1)).alias("_h"),
        F.count(F.when(F.col("stratum") == "miss", 1)).alias("not_detected"), F.count(F.when((F.col("stratum") == "miss") & F.col("needed"), 1)).alias("_m"))
    p = population.agg(F.sum(F.when(F.col("stratum") == "hit", F.col("size"))).alias("_ph"), F.sum(F.when(F.col("stratum") == "miss", F.col("size"))).alias("_pm"))
    r = a.join(F.broadcast(p)).withColumns({"precision": wilson("_h", "detected"), "missed": wilson("_m", "not_detected")})  # one row each
    tp, fn = F.col("precision.p") * F.col("_ph"), F.col("missed.p") * F.col("_pm")
    return r.select("detected", "not_detected", *[(100 * F.col(f"precision.{c}")).alias(f"precision_{c}") for c in ("p", "low", "high")],
                    *[(100 * F.col(f"missed.{c}")).alias(f"missed_{c}") for c in ("p", "low", "high")],
                    F.try_divide(100 * tp, tp + fn).alias("recall_estimate"))


def manifest_digest(fingerprints: DataFrame) -> DataFrame:
    """One digest of the session fingerprints, whatever their order, and how many there are."""
    f = F.col("fingerprint").cast("string")
    return sorted_digest(fingerprints, f, F.sha2(f, 256), "sessions")


def sensitivity_summary(cells: DataFrame) -> DataFrame:
    """Medians over sessions per grid cell, and whether paging beats forgetting in every cell."""
    by = ["min_shared", "common_frac"]
    d = cells.withColumn("_d", F.col("avoidable_pct_P0") - F.col("avoidable_pct_Pinf"))
    out = d.groupBy(*by).agg(F.count(F.lit(1)).alias("sessions"))
    out = out.join(scale.exact_medians(d, by, median_P0="avoidable_pct_P0", median_Pinf="avoidable_pct_Pinf", median_difference="_d"), by)
    all_cells = out.agg(F.bool_and(F.col("median_difference") > 0).alias("in_every_cell"))
    return out.join(F.broadcast(all_cells))  # one row
