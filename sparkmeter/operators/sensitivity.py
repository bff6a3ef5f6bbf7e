"""How far results hang on single sessions, on position and on chance: jackknife, rank correlation, matched placebos."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import scale


def _joined(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """By key, or with the single row of the right side."""
    return left.join(right, by) if by else left.join(F.broadcast(right))


def median_without(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """df with `without`, the exact median of its group's other rows; null where there are none.

    One value leaves n - 1 others, whose j-th smallest is the group's j-th, or the next one if the value is not above
    it. So three or four order statistics of the group serve all its rows, and nothing is computed once per row left
    out. Rows with a null value stand beside the median of all the others. Equal values count each.
    """
    by = list(by)
    r = scale.value_ranks(df, by, value)
    v = F.col(value).cast("double")
    low, high = F.floor((F.col("total") - 2) / 2), F.ceil((F.col("total") - 2) / 2)
    at = {"_l0": low, "_l1": low + 1, "_h0": high, "_h1": high + 1, "_m0": F.floor((F.col("total") - 1) / 2), "_m1": F.ceil((F.col("total") - 1) / 2)}
    stats = r.groupBy(*by).agg(F.max("total").alias("_n"), *[scale.at_rank(v, rank).alias(n) for n, rank in at.items()])
    out = df.join(stats, by, "left") if by else df.join(F.broadcast(stats), how="left")
    lo = F.when(v <= F.col("_l0"), F.col("_l1")).otherwise(F.col("_l0"))
    hi = F.when(v <= F.col("_h0"), F.col("_h1")).otherwise(F.col("_h0"))
    without = F.when(v.isNull(), (F.col("_m0") + F.col("_m1")) / 2).when(F.col("_n") > 1, (lo + hi) / 2)
    return out.withColumn("without", without).drop("_n", *at)


def ratio_without(df: DataFrame, by: Sequence[str], unit: str, part: str, whole: str) -> DataFrame:
    """(by, unit, part, whole, pooled, without): each unit's sums, the pooled ratio, and that of all other units."""
    by = list(by)
    units = df.groupBy(*by, unit).agg(F.sum(part).alias(part), F.sum(whole).alias(whole))
    sums = units.groupBy(*by).agg(F.sum(part).alias("_p"), F.sum(whole).alias("_w"))
    p, w = F.col("_p") - F.coalesce(part, F.lit(0)), F.col("_w") - F.coalesce(whole, F.lit(0))
    return _joined(units, sums, by).select(
        *by, unit, part, whole, (F.col("_p") / F.when(F.col("_w") != 0, F.col("_w"))).alias("pooled"), (p / F.when(w != 0, w)).alias("without"))


def drivers(left_out: DataFrame, by: Sequence[str], unit: str) -> DataFrame:
    """Of ratio_without: range of the ratios and the unit that moves the pooled one most (the least of equal ones)."""
    key = F.struct((-F.abs(F.col("without") - F.col("pooled"))).alias("d"), F.col(unit).alias("u"))
    return left_out.where("without IS NOT NULL").groupBy(*by).agg(
        F.max("pooled").alias("pooled"), F.min("without").alias("least"), F.max("without").alias("most"), F.min(key)["u"].alias("driver"))


def rank_correlations(df: DataFrame, by: Sequence[str], x: str, **measures: str) -> DataFrame:
    """(by, measure, n, rho): Spearman's correlation of x with each measure, name -> column, by group.

    Tied values share the mean of their ranks. Rows where either side is null are left out, of the ranks too. Equal
    pairs become one weighted row before any rank is looked up, and ranks come from value runs, so neither a frequent
    value nor a large group meets in one task. rho is null where a side does not vary.
    """
    by = list(by)
    keys = [*by, "measure"]
    pairs = df.select(*by, F.col(x).cast("double").alias("_x"), F.inline(F.array(*[
        F.struct(F.lit(n).alias("measure"), F.col(c).cast("double").alias("_y")) for n, c in measures.items()])))
    pairs = pairs.where("_x IS NOT NULL AND _y IS NOT NULL").groupBy(*keys, "_x", "_y").agg(F.count(F.lit(1)).alias("_c"))
    for side in ("_x", "_y"):
        runs = pairs.select(*keys, side, "_c").withColumnRenamed("_c", "_w")
        ranks = _weighted_ranks(runs, keys, side)
        pairs = pairs.join(ranks, [*keys, side])
    mid = (F.col("_n") + 1) / 2
    a, b, c = F.col("_r_x") - mid, F.col("_r_y") - mid, F.col("_c")
    out = pairs.groupBy(*keys).agg(F.sum("_c").alias("n"), F.sum(c * a * b).alias("_ab"), F.sum(c * a * a).alias("_aa"), F.sum(c * b * b).alias("_bb"))
    spread = F.sqrt(F.col("_aa")) * F.sqrt(F.col("_bb"))
    return out.select(*keys, "n", (F.col("_ab") / F.when(spread > 0, spread)).alias("rho"))


def _weighted_ranks(runs: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, _r<value>, _n): the mean rank of each value, from 1, where a row stands for `_w` equal ones."""
    r = scale.value_ranks(runs, keys, value, weight="_w")
    cols = [*keys, value, (F.col("before") + (F.col("copies") + 1) / 2).alias(f"_r{value}")]
    return r.select(*cols, *([F.col("total").alias("_n")] if value == "_x" else []))


def draw(seed: int, n: Column, *key: Column) -> Column:
    """A number below n that hangs on the seed and the key alone, whatever the partitioning."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in key]))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint") % n


def matched_placebos(calls: DataFrame, points: DataFrame, tried: Column, failed: Column, window: int = 10, draws: int = 20, seed: int = 1) -> DataFrame:
    """Attempts and failures in the `window` calls from each point on, beside those from random calls of the same session.

    calls: session_id, k (dense, from 0). points: session_id, k, no more than one a call. One row per session with a
    point: points, tried and failed at them, and their means a draw at the placebos. Each point has `draws` placebos
    among its session's calls, drawn by hash. A window ends with its session. Windows are differences of running
    sums, looked up by call, so their length costs nothing.
    """
    one = lambda c: F.coalesce(c, F.lit(False)).cast("bigint")
    sums = scale.scan(calls, ["session_id"], ["k"], _t=scale.running_sum(one(tried)), _f=scale.running_sum(one(tried & failed)))
    sums = sums.select("session_id", "k", "_t", "_f")
    sizes = calls.groupBy("session_id").agg((F.max("k") + 1).alias("_n"))
    p = points.select("session_id", F.col("k").alias("_k")).distinct().join(sizes, "session_id")
    p = p.withColumn("_d", F.explode(F.sequence(F.lit(0), F.lit(draws))))
    at = F.when(F.col("_d") == 0, F.col("_k")).otherwise(draw(seed, F.col("_n"), F.col("session_id"), F.col("_k"), F.col("_d")))
    p = p.withColumn("_a", at).select("session_id", "_d", F.inline(F.array(
        F.struct((F.least(F.col("_a") + window, "_n") - 1).alias("k"), F.lit(1).alias("_sign")),
        F.struct((F.col("_a") - 1).alias("k"), F.lit(-1).alias("_sign")))))
    p = p.groupBy("session_id", "k").agg(*[F.sum(F.when(w, F.col("_sign")).otherwise(0)).alias(n) for n, w in (("_real", F.col("_d") == 0), ("_placebo", F.col("_d") > 0))],
                                         F.sum(((F.col("_d") == 0) & (F.col("_sign") == 1)).cast("bigint")).alias("_p"))
    got = p.join(sums, ["session_id", "k"]).groupBy("session_id").agg(
        F.sum("_p").alias("points"), F.sum(F.col("_real") * F.col("_t")).alias("tried"), F.sum(F.col("_real") * F.col("_f")).alias("failed"),
        (F.sum(F.col("_placebo") * F.col("_t")) / draws).alias("placebo_tried"), (F.sum(F.col("_placebo") * F.col("_f")) / draws).alias("placebo_failed"))
    return got
