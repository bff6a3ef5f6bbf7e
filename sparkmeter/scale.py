"""Ordered computations that stay exact and distributed when one group holds much of the data.

A plain ``Window.partitionBy(session)`` sends a whole session to one task. Here every ordered
step goes through :func:`scan`. As long as no group is large it is that plain window. When
:func:`with_blocks` has found large groups, it has cut them into consecutive order ranges
(column ``blk``), and :func:`scan` becomes a two-level prefix scan: windows inside
(group, block), one summary row per block, a window over the block summaries, and an equi-join
of the carries back to the rows.

:func:`fold` does the same for folds that are not associative (replays): arrays are built per
bounded block, all blocks are replayed in parallel, and the states handed from block to block
are iterated to their fixed point, which is the sequential result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .session import ensure_checkpoint_dir, prepare

BLOCK = "blk"
HOT_MIN_ROWS = 2_000_000  # a group below this many rows is never split
MAX_HOT_GROUPS = 1_000  # a group is split only above rows/MAX_HOT_GROUPS, so at most this many are


def with_blocks(df: DataFrame, by: Sequence[str], order: str, min_rows: int = HOT_MIN_ROWS) -> DataFrame:
    """Add ``blk``, a block number that never decreases along ``order``, if some group is large.

    Large: more than max(min_rows, rows / MAX_HOT_GROUPS) rows. Both things that reach the driver
    are bounded by that definition: fewer than MAX_HOT_GROUPS groups, and about one cut point per
    rows / MAX_HOT_GROUPS rows. Cut points are values, fixed once here, so every later use of the
    column is deterministic.
    """
    rows = df.count()
    limit = max(min_rows, rows // MAX_HOT_GROUPS)
    if rows <= limit:
        return df
    by = list(by)
    keys = by or [F.lit(0).alias("_all")]
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > limit)
    names = sizes.columns[:-1]
    hot = sizes.withColumn("_parts", F.least(F.ceil(F.col("_rows") / limit), F.lit(MAX_HOT_GROUPS)).cast("int"))
    if hot.isEmpty():
        return df
    points = [i / MAX_HOT_GROUPS for i in range(1, MAX_HOT_GROUPS)]
    src = df if by else df.withColumn("_all", F.lit(0))
    cuts = (
        src.join(F.broadcast(hot), names)  # fewer than MAX_HOT_GROUPS rows
        .groupBy(*names)
        .agg(F.percentile_approx(order, points, 10_000).alias("_p"), F.first("_parts").alias("_parts"))
        .select(*names, F.expr(
            f"array_distinct(transform(sequence(1, _parts - 1), i -> _p[cast(i * {MAX_HOT_GROUPS} / _parts as int) - 1]))"
        ).alias("_cuts"))
    )
    cuts = df.sparkSession.createDataFrame(cuts.collect(), cuts.schema)
    out = src.join(F.broadcast(cuts), names, "left")
    n_cuts = F.size(F.filter("_cuts", lambda c: c <= F.col(order)))
    out = out.withColumn(BLOCK, F.when(F.col("_cuts").isNull(), 0).otherwise(n_cuts))
    return out.drop("_cuts", "_all")


def grouped(df: DataFrame, by: Sequence[str], rows: int, per_task: int = 50_000) -> DataFrame:
    """Rows of a group in one partition, about ``per_task`` rows to each, however many rows there are.

    The windows of one stage hold all their sorted rows at once, so what a task holds would grow with its partition.
    Below one such partition per core the session's own number stands.
    """
    n = -(-rows // per_task)
    return df.repartition(n, *by) if n > df.sparkSession.sparkContext.defaultParallelism else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and every executor reach, as the session or, in local runs, a scratch folder names it."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """A table that several branches read, written once to a folder of its own, of which each reads the columns it needs."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    return df.sparkSession.read.parquet(path)


def materialize(df: DataFrame) -> DataFrame:
    """Write an intermediate that several branches read to the checkpoint folder, and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


# ---------------------------------------------------------------- scan


@dataclass(frozen=True)
class Op:
    kind: str
    expr: Column | None = None
    inclusive: bool = True


def running_sum(expr: Column, inclusive: bool = True) -> Op:
    return Op("sum", expr, inclusive)


def running_max(expr: Column, inclusive: bool = True) -> Op:
    return Op("max", expr, inclusive)


def row_index() -> Op:
    """0-based dense position."""
    return Op("sum", F.lit(1).cast("bigint"), False)


def previous(expr: Column) -> Op:
    return Op("prev", expr)


def following(expr: Column) -> Op:
    return Op("next", expr)


def last_known(expr: Column, inclusive: bool = True) -> Op:
    """Latest non-null value at or before (inclusive) the row: the as-of lookup."""
    return Op("last", expr, inclusive)


def next_known(expr: Column, inclusive: bool = True) -> Op:
    """Earliest non-null value at or after (inclusive) the row."""
    return Op("first", expr, inclusive)


def _local(op: Op, w) -> Column:
    back = w.rowsBetween(Window.unboundedPreceding, 0 if op.inclusive else -1)
    ahead = w.rowsBetween(0 if op.inclusive else 1, Window.unboundedFollowing)
    if op.kind == "sum":
        return F.coalesce(F.sum(op.expr).over(back), F.lit(0))
    if op.kind == "max":
        return F.max(op.expr).over(back)
    if op.kind == "prev":
        return F.lag(op.expr).over(w)
    if op.kind == "next":
        return F.lead(op.expr).over(w)
    if op.kind == "last":
        return F.last(op.expr, ignorenulls=True).over(back)
    if op.kind == "first":
        return F.first(op.expr, ignorenulls=True).over(ahead)
    raise ValueError(op.kind)


def scan(df: DataFrame, by: Sequence[str], order: Sequence[str], **ops: Op) -> DataFrame:
    """Add one column per op, computed along ``order`` inside each ``by`` group."""
    by, order = list(by), list(order)
    prepare(df.sparkSession)
    if BLOCK not in df.columns:
        w = Window.partitionBy(*by).orderBy(*order)
        return df.withColumns({name: _local(op, w) for name, op in ops.items()})

    at = F.struct(*order)
    w = Window.partitionBy(*by, BLOCK).orderBy(*order)
    over_blocks = Window.partitionBy(*by).orderBy(BLOCK)
    before = over_blocks.rowsBetween(Window.unboundedPreceding, -1)
    after = over_blocks.rowsBetween(1, Window.unboundedFollowing)
    local, summary, carry, final = {}, [], {}, {}
    for name, op in ops.items():
        c = f"_c_{name}"
        if op.kind in ("prev", "next"):
            boxed = Op(op.kind, F.struct(op.expr.alias("v")))
            local[name] = _local(boxed, w)
            pick = F.max_by if op.kind == "prev" else F.min_by
            summary.append(pick(F.struct(op.expr.alias("v")), at).alias(c))
            carry[c] = (F.lag if op.kind == "prev" else F.lead)(c).over(over_blocks)
            final[name] = F.coalesce(F.col(name), F.col(c))["v"]
            continue
        local[name] = _local(op, w)
        if op.kind == "sum":
            summary.append(F.sum(op.expr).alias(c))
            carry[c] = F.sum(c).over(before)
            final[name] = F.col(name) + F.coalesce(F.col(c), F.lit(0))
        elif op.kind == "max":
            summary.append(F.max(op.expr).alias(c))
            carry[c] = F.max(c).over(before)
            final[name] = F.greatest(F.col(name), F.col(c))
        elif op.kind == "last":
            summary.append(F.max_by(op.expr, F.when(op.expr.isNotNull(), at)).alias(c))
            carry[c] = F.last(c, ignorenulls=True).over(before)
            final[name] = F.coalesce(F.col(name), F.col(c))
        else:
            summary.append(F.min_by(op.expr, F.when(op.expr.isNotNull(), at)).alias(c))
            carry[c] = F.first(c, ignorenulls=True).over(after)
            final[name] = F.coalesce(F.col(name), F.col(c))
    carries = df.groupBy(*by, BLOCK).agg(*summary).withColumns(carry)
    out = df.withColumns(local).join(carries, [*by, BLOCK], "left").withColumns(final)
    return out.drop(*carry)


# ---------------------------------------------------------------- exact order statistics


def value_ranks(df: DataFrame, by: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """(by, value, blk, copies, before, total): each distinct value with how many rows precede it.

    With a weight, a row stands for so many equal ones. Rows are first combined by value on the map side, so copies of one value cost one row. Values
    are ranked in blocks of equal magnitude (64 per octave, a few thousand at most per group), so
    even one global ranking is spread over tasks.
    """
    by = list(by)
    v = F.col(value).cast("double")
    magnitude = F.floor(F.signum(v) * F.log2(F.abs(v) + 1) * 64).cast("int")
    runs = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("copies"))
    runs = runs.withColumn(BLOCK, magnitude)
    blocks = runs.groupBy(*by, BLOCK).agg(F.sum("copies").alias("_s"))
    over = Window.partitionBy(*by)  # block sums only
    blocks = blocks.withColumns({
        "_b": F.sum("_s").over(over.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)), "total": F.sum("_s").over(over)})
    w = Window.partitionBy(*by, BLOCK).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("before", F.sum("copies").over(w)).join(blocks, [*by, BLOCK])
    runs = runs.withColumn("before", F.coalesce("before", F.lit(0)) + F.coalesce("_b", F.lit(0)))
    return runs.select(*by, value, BLOCK, "copies", "before", "total")


def at_rank(value: Column | str, rank: Column) -> Column:
    """Aggregate over value_ranks rows: the value holding a 0-based rank."""
    held = (rank >= F.col("before")) & (rank < F.col("before") + F.col("copies"))
    return F.max(F.when(held, F.col(value) if isinstance(value, str) else value))


def exact_percentiles(df: DataFrame, by: Sequence[str], value: str, **qs: float) -> DataFrame:
    """Linear-interpolated quantiles without holding a group's values in one aggregation buffer."""
    by = list(by)
    r = value_ranks(df, by, value)
    v = F.col(value).cast("double")
    aggs = []
    for name, q in qs.items():
        pos = F.lit(q) * (F.col("total") - 1)
        aggs += [at_rank(v, F.floor(pos)).alias(f"_lo_{name}"), at_rank(v, F.ceil(pos)).alias(f"_hi_{name}"),
                 F.max(pos - F.floor(pos)).alias(f"_f_{name}")]
    out = r.groupBy(*by).agg(*aggs)
    return out.select(*by, *[
        (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_f_{n}")).alias(n) for n in qs
    ])


def exact_medians(df: DataFrame, by: Sequence[str], **values: str) -> DataFrame:
    """Medians of several columns in one pass: name -> column, ranked side by side as measures."""
    by = list(by)
    long = df.select(*by, F.inline(F.array(*[
        F.struct(F.lit(n).alias("_measure"), F.col(c).cast("double").alias("_value")) for n, c in values.items()])))
    m = exact_percentiles(long, [*by, "_measure"], "_value", _q=0.5)
    return m.groupBy(*by).agg(*[F.max(F.when(F.col("_measure") == n, F.col("_q"))).alias(n) for n in values])


# ---------------------------------------------------------------- bounded folds


def fold(df: DataFrame, by: Sequence[str], index: str, item: Column, params: Sequence[Column],
         first_state: Column, guess_state: Column, step: Callable[[Column, Column, Column], Column],
         carried: Callable[[Column], Column], block_rows: int = 20_000, max_rounds: int = 10_000) -> DataFrame:
    """Sequential fold along ``index`` (dense, 0-based) for groups of any length.

    ``item`` is the per-row struct; ``params`` are group-level columns. State is a struct;
    ``step(state, item, params)`` gives the next one; ``carried(state)`` resets the tallies and
    keeps only what the next block must know. Groups are cut into blocks of ``block_rows`` rows, so no
    array is longer than that. One block per group needs one pass. Otherwise all blocks are
    replayed in parallel from ``guess_state``; then each block is replayed from the state its
    predecessor ended in, until nothing changes. When every block starts where the previous one
    ended, the chain equals the sequential fold. Returns (by, state) rows, one per block: add the
    tallies up by group.
    """
    by, params = list(by), list(params)
    cols = df.select(*by, F.floor(F.col(index) / block_rows).cast("bigint").alias("_b"), F.col(index).alias("_i"),
                     item.alias("_x"), *params, first_state.alias("_first"), guess_state.alias("_guess"))
    names = cols.columns[len(by) + 3:-2]
    blocks = cols.groupBy(*by, "_b").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda e: e["_x"]).alias("_xs"),
        *[F.first(n).alias(n) for n in names],
        F.min_by(F.when(F.col("_b") == 0, F.col("_first")).otherwise(F.col("_guess")), "_i").alias("_in"),
    )

    def replay(frame: DataFrame) -> DataFrame:
        p = F.struct(*names) if names else F.lit(None)
        return frame.withColumn("_out", F.aggregate("_xs", F.col("_in"), lambda s, x: step(s, x, p)))

    done = replay(blocks)
    longest = df.agg(F.max(index).alias("m")).first()["m"]
    if longest is None or longest < block_rows:
        return done.select(*by, "_b", F.col("_out").alias("state"))
    ensure_checkpoint_dir(df.sparkSession)
    over = Window.partitionBy(*by).orderBy("_b")  # block summaries only
    done = done.checkpoint()
    for _ in range(max_rounds):
        handed = done.select(*by, "_b", F.lag(carried(F.col("_out"))).over(over).alias("_h"))
        nxt = done.join(handed, [*by, "_b"]).withColumn("_h", F.coalesce("_h", "_in"))
        moved = nxt.withColumn("_moved", ~F.col("_h").eqNullSafe(F.col("_in")))
        if moved.where("_moved").isEmpty():
            return done.select(*by, "_b", F.col("_out").alias("state"))
        done = replay(moved.withColumn("_in", F.col("_h")).drop("_h", "_moved", "_out")).checkpoint()
    raise RuntimeError(f"the fold did not settle in {max_rounds} rounds")
