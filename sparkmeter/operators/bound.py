"""Offline-optimal context bound: what a session had to keep, given what its calls later used.

A segment of n tokens is resident from ``birth`` to ``end`` (next compaction or last call). It is
needed at birth and at every later call of its window whose output shares distinctive terms with
it. Between two needs it is kept (n per call) or dropped and fetched again at cost P, whichever is
less; the choice per gap is independent, so sums over gaps are the optimum.

Windows never cross a compaction, so segment and call meet on (session, epoch, term): an equi-join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import scale
from ..functions.numbers import percent

PENALTIES = (0.0, 1_000.0, 10_000.0, float("inf"))
PINNED = "unattributed"
EARLY_KINDS = ["user_prompt", "harness", "compact_summary"]
MIN_SHARED = (1, 2, 3)
COMMON_FRACTIONS = (0.01, 0.02, 0.05)
METHOD = "lexical-v1"
SEG = ["session_id", "seg_id"]


def penalty_name(p: float) -> str:
    return "Pinf" if p == float("inf") else f"P{int(p)}"


def origin() -> Column:
    """The call a segment came from: prompts arrive at the call that reads them."""
    return F.when(F.col("kind").isin(EARLY_KINDS), F.col("birth")).otherwise(F.col("birth") - 1)


def _with_epoch(calls: DataFrame) -> DataFrame:
    return calls if "epoch" in calls.columns else calls.withColumn("epoch", F.lit(0).cast("bigint"))


def windows(segments: DataFrame, calls: DataFrame) -> DataFrame:
    """Add epoch and end. Segments born after the last call keep an empty window."""
    c = _with_epoch(calls)
    ends = c.groupBy("session_id", "epoch").agg((F.max("k") + 1).alias("end"))
    at = c.select("session_id", F.col("k").alias("birth"), "epoch")
    out = segments.join(at, ["session_id", "birth"], "left").join(ends, ["session_id", "epoch"], "left")
    return out.withColumn("end", F.coalesce("end", "birth"))


def term_frequency(terms: DataFrame) -> DataFrame:
    """(session_id, term, df, active): outputs holding the term; outputs with any term."""
    df = terms.groupBy("session_id", "term").agg(F.count_distinct("k").alias("df"))
    active = terms.groupBy("session_id").agg(F.count_distinct("k").alias("active"))
    return df.join(active, "session_id")


def is_common(frac: float) -> Column:
    return F.col("df") > F.greatest(F.lit(3.0), F.lit(frac) * F.col("active"))


def use_index(terms: DataFrame, frac: float | None) -> DataFrame:
    """term -> calls, without common terms (all terms with their counts if frac is None)."""
    f = term_frequency(terms)
    f = f if frac is None else f.where(~is_common(frac)).drop("df", "active")
    return terms.join(f, ["session_id", "term"])


def shared_counts(wins: DataFrame, terms: DataFrame, calls: DataFrame, fractions: Sequence[float]) -> DataFrame:
    """(session_id, seg_id, tokens, k, shared_<i>): later calls of the window and how many non-common
    terms they share, for each cut-off. Terms common at every cut-off never enter the join."""
    c = _with_epoch(calls).select("session_id", "k", "epoch")
    used = use_index(terms, None).where(~is_common(max(fractions))).join(c, ["session_id", "k"])
    mine = wins.where((F.col("kind") != PINNED) & (F.col("birth") < F.col("end"))) \
        .select(*SEG, "epoch", "birth", "tokens", F.explode("terms").alias("term"))
    pairs = mine.join(used, ["session_id", "epoch", "term"]).where(F.col("k") > F.col("birth"))
    counts = [F.count(F.when(~is_common(f), 1)).alias(f"shared_{i}") for i, f in enumerate(fractions)]
    return pairs.groupBy(*SEG, "tokens", "k").agg(*counts)


def link(segments: DataFrame, terms: DataFrame, calls: DataFrame, min_shared: int = 1, common_frac: float = 0.02,
         placebo: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(windows, refs). refs: (session_id, seg_id, tokens, k), birth included; pinned segments have none
    because every call of their window counts (closed form)."""
    if placebo not in (None, "mirror"):
        raise ValueError(f"unknown placebo {placebo!r}")
    wins = windows(segments, calls)
    later = shared_counts(wins, terms, calls, [common_frac]).where(F.col("shared_0") >= min_shared).drop("shared_0")
    if placebo == "mirror":
        kept = mirror_test(wins, later, terms, min_shared, common_frac).where("kept").select(*SEG)
        later = later.join(kept, SEG, "left_semi")
    born = wins.where((F.col("kind") != PINNED) & (F.col("birth") < F.col("end"))).select(*SEG, "tokens", F.col("birth").alias("k"))
    return wins, born.unionByName(later)


def mirror_test(wins: DataFrame, later: DataFrame, terms: DataFrame, min_shared: int = 1, common_frac: float = 0.02) -> DataFrame:
    """Per reused segment, whether its later uses beat the calls mirrored before its origin by two sigma."""
    s = wins.where((F.col("kind") != PINNED) & (F.col("birth") < F.col("end")))
    s = s.withColumns({"o": origin(), "w": F.col("end") - F.col("birth") - 1})
    s = s.withColumn("lo", F.greatest(F.lit(0), F.col("o") - F.col("w")))
    s = s.withColumn("avail", F.greatest(F.lit(0), F.col("o") - F.col("lo")))
    mine = s.where("avail > 0").select(*SEG, "lo", "o", F.explode("terms").alias("term"))
    pairs = mine.join(use_index(terms, common_frac), ["session_id", "term"]).where((F.col("k") >= F.col("lo")) & (F.col("k") < F.col("o")))
    hit = pairs.groupBy(*SEG, "k").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= min_shared) \
        .groupBy(*SEG).agg(F.count(F.lit(1)).alias("hit"))
    s = s.join(hit, SEG, "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    pool = s.groupBy("session_id", "kind").agg(F.try_divide(F.sum("hit"), F.sum("avail")).alias("pooled"))
    seen = later.groupBy(*SEG).agg(F.count(F.lit(1)).alias("n_obs"))
    s = s.join(pool, ["session_id", "kind"]).join(seen, SEG)
    p = F.when(F.col("avail") > 0, F.col("hit") / F.col("avail")).otherwise(F.coalesce("pooled", F.lit(0.0)))
    s = s.withColumns({"p": p, "fallback": F.col("avail") == 0})
    bar = F.col("p") * F.col("w") + 2 * F.sqrt(F.col("w") * F.col("p") * (1 - F.col("p")))
    return s.withColumn("kept", F.col("n_obs") > bar).select(*SEG, "n_obs", "w", "hit", "avail", "p", "fallback", "kept")


# ---------------------------------------------------------------- calibration


def calibrate(segments: DataFrame, calls: DataFrame, min_tokens: int = 2_000, order: list[str] = ("k",)) -> tuple[DataFrame, DataFrame]:
    """(segments scaled to measured growth plus the unattributed rest, factor per session)."""
    c = scale.scan(_with_epoch(calls), ["session_id"], list(order), _p=scale.previous(F.col("context")),
                   _pe=scale.previous(F.col("epoch")), _c0=scale.last_known(F.when(F.col("k") == 0, F.col("context"))))
    est = segments.groupBy("session_id", F.col("birth").alias("k")).agg(F.sum("tokens").alias("est"))
    c = c.join(est, ["session_id", "k"], "left").withColumn("est", F.coalesce("est", F.lit(0.0)))
    restart = F.col("_p").isNull() | (F.col("epoch") != F.col("_pe"))
    ratio = F.when(~restart & (F.col("est") >= min_tokens) & (F.col("context") > F.col("_p")), (F.col("context") - F.col("_p")) / F.col("est"))
    c = c.withColumns({"ratio": ratio, "grown": F.when(F.col("k") == 0, 0).otherwise(
        F.col("context") - F.when(restart, F.col("_c0")).otherwise(F.col("_p"))).cast("double")})
    ranks = scale.value_ranks(c, ["session_id"], "ratio")
    middle = F.floor(F.col("total") / 2)  # the upper median
    factor = ranks.where((F.col("total") >= 5) & (middle >= F.col("before")) & (middle < F.col("before") + F.col("copies"))) \
        .select("session_id", F.col("ratio").alias("factor"))
    factor = calls.select("session_id").distinct().join(factor, "session_id", "left").withColumn("factor", F.coalesce("factor", F.lit(1.0)))
    c = c.join(factor, "session_id")
    fit = F.when((F.col("est") > 0) & (F.col("grown") > 0), F.least("factor", F.col("grown") / F.col("est"))).otherwise(F.col("factor"))
    c = c.withColumn("scale", F.when(F.col("k") == 0, 0.0).otherwise(fit))
    scales = c.select("session_id", F.col("k").alias("birth"), "scale")
    scaled = segments.join(scales, ["session_id", "birth"], "left")
    scaled = scaled.withColumn("tokens", F.col("tokens") * F.coalesce("scale", F.lit(1.0))).drop("scale")
    keep = ["session_id", "seg_id", "kind", "tokens", "birth", "terms"]
    rest = c.select("session_id", F.xxhash64("session_id", F.lit(PINNED), "k").alias("seg_id"), F.lit(PINNED).alias("kind"),
                    (F.col("grown") - F.col("est") * F.col("scale")).alias("tokens"), F.col("k").alias("birth"),
                    F.array().cast("array<string>").alias("terms")).where("tokens <> 0")
    return scaled.select(*keep).unionByName(rest.select(*keep)), factor


# ---------------------------------------------------------------- cost


def with_gaps(refs: DataFrame) -> DataFrame:
    """gap: calls from the previous need to this one (null at birth)."""
    return scale.scan(refs, SEG, ["k"], _p=scale.previous(F.col("k"))).withColumn("gap", F.col("k") - F.col("_p")).drop("_p")


def segment_needs(wins: DataFrame, refs: DataFrame, penalties: Sequence[float] = PENALTIES) -> DataFrame:
    """Windows with uses m, last use, resident token-calls, and needed token-calls per penalty."""
    g = with_gaps(refs)
    held = [F.sum(F.when(F.col("gap").isNotNull(), F.least(F.col("tokens") * (F.col("gap") - 1), F.lit(p)))).alias(f"_g{i}")
            for i, p in enumerate(penalties)]
    use = g.groupBy(*SEG).agg(F.count(F.lit(1)).alias("m"), F.max("k").alias("last"), *held)
    s = wins.drop("terms").join(use, SEG, "left")
    span = F.greatest(F.lit(0), F.col("end") - F.col("birth"))
    s = s.withColumn("resident", F.col("tokens") * span)
    need = {}
    for i, p in enumerate(penalties):
        own = F.col("tokens") * F.coalesce("m", F.lit(0)) + F.coalesce(f"_g{i}", F.lit(0.0))
        need[f"need_{penalty_name(p)}"] = F.when(F.col("kind") == PINNED, F.col("resident")).otherwise(own)
    return s.withColumns(need).drop(*[f"_g{i}" for i in range(len(penalties))])


def bound(needs: DataFrame, calls: DataFrame, penalties: Sequence[float] = PENALTIES) -> DataFrame:
    """One row per session: measured, resident, pinned, and avoidable % per penalty."""
    m = calls.groupBy("session_id").agg(F.count(F.lit(1)).alias("api_calls"), F.sum("context").alias("measured_input"))
    names = [penalty_name(p) for p in penalties]
    s = needs.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("segments"), F.sum("resident").alias("resident"),
        F.sum(F.when(F.col("kind") == PINNED, F.col("resident")).otherwise(0.0)).alias("_pin"),
        *[F.sum(f"need_{n}").alias(f"need_{n}") for n in names])
    out = m.join(s, "session_id", "left").fillna(0)
    out = out.withColumn("pinned_input", F.col("measured_input") - F.col("resident") + F.col("_pin")).drop("_pin")
    return with_policies(out, names)


def with_policies(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    return rows.withColumns({
        **{f"bound_{n}": F.col("measured_input") - (F.col("resident") - F.col(f"need_{n}")) for n in names},
        **{f"avoidable_pct_{n}": percent(F.col("resident") - F.col(f"need_{n}"), "measured_input") for n in names}})


def policy_rows(bounds: DataFrame, penalties: Sequence[float] = PENALTIES) -> DataFrame:
    """Long form: (session_id, policy, needed, bound_input, avoidable_pct)."""
    rows = [F.struct(F.lit(n).alias("policy"), F.col(f"need_{n}").alias("needed"), F.col(f"bound_{n}").alias("bound_input"),
                     F.col(f"avoidable_pct_{n}").alias("avoidable_pct")) for n in map(penalty_name, penalties)]
    return bounds.select("session_id", "measured_input", "resident", F.inline(F.array(*rows)))


def instruction_ends(calls: DataFrame, starts: DataFrame) -> DataFrame:
    """Per call k: the first instruction start at or after it, and the first one strictly after it."""
    s = starts.select("session_id", F.col("start_k").alias("k")).distinct().withColumn("_s", F.col("k"))
    keep = [scale.BLOCK] if scale.BLOCK in calls.columns else []
    c = calls.select("session_id", "k", *keep).join(s, ["session_id", "k"], "left")
    return scale.scan(c, ["session_id"], ["k"], at_or_after=scale.next_known(F.col("_s")),
                      after=scale.next_known(F.col("_s"), inclusive=False)).select("session_id", "k", "at_or_after", "after")


def carried_parts(needs: DataFrame, refs: DataFrame, calls: DataFrame, starts: DataFrame) -> DataFrame:
    """Segments that outlive the instruction they were born in: a (first call after it), and the
    resident, dead (after last use) and idle (unused there) token-calls from a on."""
    ends = instruction_ends(calls, starts)
    s = needs.where((F.col("kind") != PINNED) & (F.col("end") > F.col("birth"))).withColumn("o", origin())
    s = s.join(ends.withColumnRenamed("k", "_k"), (s["session_id"] == ends["session_id"]) & (F.greatest(s["o"], F.lit(0)) == F.col("_k")), "left") \
        .drop(ends["session_id"])
    nxt = F.when(F.col("o") < 0, F.col("at_or_after")).otherwise(F.col("after"))
    s = s.withColumn("a", F.greatest(F.coalesce(nxt, "end"), "birth")).where("a < end")
    used = refs.select(*SEG, "k").join(s.select(*SEG, "a"), SEG).where("k >= a").groupBy(*SEG).agg(F.count(F.lit(1)).alias("used"))
    s = s.join(used, SEG, "left")
    left = F.col("end") - F.col("a")
    return s.withColumns({
        "lo": F.greatest("a", F.col("last") + 1),
        "carried": F.col("tokens") * left,
        "dead": F.col("tokens") * F.greatest(F.lit(0), F.col("end") - F.greatest("a", F.col("last") + 1)),
        "idle": F.col("tokens") * (left - F.coalesce("used", F.lit(0)))})


def carried(parts: DataFrame) -> DataFrame:
    return parts.groupBy("session_id").agg(F.sum("carried").alias("carried"), F.sum("dead").alias("dead"), F.sum("idle").alias("idle"))


def by_kind(needs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    k = needs.groupBy(*by, "kind").agg(F.count(F.lit(1)).alias("segments"), F.sum("tokens").alias("tokens"), F.sum("resident").alias("resident"),
                                       F.sum("need_P0").alias("need_P0"), F.sum("need_Pinf").alias("need_Pinf"))
    return k.withColumns({"dead_after_last_use_pct": percent(F.col("resident") - F.col("need_Pinf"), "resident"),
                          "unneeded_pct": percent(F.col("resident") - F.col("need_P0"), "resident")})


def merge(bounds: DataFrame, penalties: Sequence[float] = PENALTIES) -> DataFrame:
    """Corpus row; fails if the rows come from different methods."""
    names = [penalty_name(p) for p in penalties]
    sums = ["api_calls", "segments", "measured_input", "resident", "pinned_input"] + [f"need_{n}" for n in names]
    aggs = [F.count(F.lit(1)).alias("sessions"), *[F.sum(c).alias(c) for c in sums]]
    if "method" in bounds.columns:
        aggs.append(F.collect_set("method").alias("_m"))  # a handful of names
    m = bounds.agg(*aggs)
    if "method" in bounds.columns:
        bad = F.size("_m") > 1
        m = m.withColumn("method", F.when(bad, F.raise_error(F.lit("cannot merge reports of different methods"))).otherwise(F.col("_m")[0])).drop("_m")
    return with_policies(m, names)


def export(bounds: DataFrame, limit: int = 200) -> DataFrame:
    """Numbers only, one row per session, at most the contribution limit."""
    pct = [f"avoidable_pct_{penalty_name(p)}" for p in PENALTIES]
    return bounds.orderBy("session_id").limit(limit).select(
        "api_calls", "measured_input", percent("pinned_input", "measured_input").alias("pinned_pct"), *pct)


def sensitivity(segments: DataFrame, terms: DataFrame, calls: DataFrame, min_shared: Sequence[int] = MIN_SHARED,
                fractions: Sequence[float] = COMMON_FRACTIONS) -> DataFrame:
    """(session_id, min_shared, common_frac, avoidable_pct_P0, avoidable_pct_Pinf) for the whole grid.

    Shared terms are counted once per cut-off; the nine cells are conditional sums over the same rows:
    P=0 needs the number of uses, P=inf the last use.
    """
    wins = windows(segments, calls)
    shared = shared_counts(wins, terms, calls, fractions)
    aggs = []
    for i, _ in enumerate(fractions):
        for m in min_shared:
            hit = F.col(f"shared_{i}") >= m
            aggs += [F.count(F.when(hit, 1)).alias(f"_m_{i}_{m}"), F.max(F.when(hit, F.col("k"))).alias(f"_l_{i}_{m}")]
    s = wins.drop("terms").join(shared.groupBy(*SEG).agg(*aggs), SEG, "left")
    span = F.greatest(F.lit(0), F.col("end") - F.col("birth"))
    free = (F.col("kind") != PINNED) & (span > 0)
    sums = [F.sum(F.col("tokens") * span).alias("resident")]
    for i, _ in enumerate(fractions):
        for m in min_shared:
            uses = 1 + F.coalesce(f"_m_{i}_{m}", F.lit(0))
            reach = F.coalesce(f"_l_{i}_{m}", "birth") - F.col("birth") + 1
            sums += [F.sum(F.col("tokens") * F.when(free, uses).otherwise(span)).alias(f"_n0_{i}_{m}"),
                     F.sum(F.col("tokens") * F.when(free, reach).otherwise(span)).alias(f"_ni_{i}_{m}")]
    t = calls.groupBy("session_id").agg(F.sum("context").alias("measured_input"))
    t = t.join(s.groupBy("session_id").agg(*sums), "session_id")
    cells = [F.struct(F.lit(m).cast("bigint").alias("min_shared"), F.lit(f).alias("common_frac"),
                      percent(F.col("resident") - F.col(f"_n0_{i}_{m}"), "measured_input").alias("avoidable_pct_P0"),
                      percent(F.col("resident") - F.col(f"_ni_{i}_{m}"), "measured_input").alias("avoidable_pct_Pinf"))
             for i, f in enumerate(fractions) for m in min_shared]
    return t.select("session_id", F.inline(F.array(*cells)))
