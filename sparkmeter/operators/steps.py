"""Step classes, edit-verify loops and polling runs inside instructions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import scale

#: Classes by falling priority; a step with several uses takes the first that occurs.
CLASSES = ("sub-agent", "edit", "verify", "vcs", "poll", "mcp", "read", "other")
TOOLS = {
    "edit": ("Write", "Edit", "MultiEdit", "NotebookEdit"),
    "read": ("Read", "Grep", "Glob", "LS"),
    "sub-agent": ("Task", "Agent", "SubagentHandback", "ListAgents", "SendMessage"),
    "poll": ("Monitor", "ScheduleWakeup", "ReadNotifications"),
}
#: Command words by class, tried in this order.
COMMANDS = {
    "vcs": r"\bgit +(add|commit|push|checkout|switch|merge|rebase|reset|stash|cherry-pick|tag)\b|\bgh +pr +(create|merge)\b",
    "poll": r"\b(sleep|until|watch|wait|curl|wget)\b|\bgh +(run|pr|api|issue)\b",
    "edit": r"\b(sed +-i|tee|mv|cp|rm|mkdir|touch)\b|\bcat *>",
    "verify": r"\b(pytest|python[0-9.]*|npm|npx|node|make|cargo|go|tsc|eslint|ruff|playwright|docker)\b",
    "read": r"\b(cat|head|tail|sed|grep|rg|find|ls|jq|wc)\b|\bgit +(log|show|diff|status)\b",
}
QUOTED = "'[^']*'|\"[^\"]*\""


def step_class(name: Column, command: Column) -> Column:
    """The class of one tool use, by tool and, for shell commands, by the words outside quotes."""
    bare = F.regexp_replace(F.coalesce(command, F.lit("")), QUOTED, "")
    shell = F.coalesce(*[F.when(bare.rlike(p), c) for c, p in COMMANDS.items()], F.lit("other"))
    by_tool = F.coalesce(*[F.when(name.isin(*tools), c) for c, tools in TOOLS.items()], F.when(name.startswith("mcp__"), "mcp"))
    return F.when(name == "Bash", shell).otherwise(F.coalesce(by_tool, F.lit("other")))


def classify(calls: DataFrame, uses: DataFrame) -> DataFrame:
    """Calls with `cls` (`text-only` without uses), `failed` (an error in a verifying use) and `seen`, a sum over the
    hashes of its results. uses: session_id, call_k, name, command, is_error, result_hash, each of which may be null."""
    rank = F.coalesce(*[F.when(F.col("_c") == c, i) for i, c in enumerate(CLASSES)])
    per = uses.withColumn("_c", step_class(F.col("name"), F.col("command"))).groupBy("session_id", F.col("call_k").alias("k")).agg(
        F.min(rank).alias("_r"), F.coalesce(F.max(F.col("is_error") & (F.col("_c") == "verify")), F.lit(False)).alias("failed"),
        F.sum(F.col("result_hash").cast("decimal(38,0)")).alias("seen"))
    cls = F.coalesce(F.get(F.array(*map(F.lit, CLASSES)), F.col("_r")), F.lit("text-only"))
    return calls.join(per, ["session_id", "k"], "left").withColumns({"cls": cls, "failed": F.coalesce("failed", F.lit(False))}).drop("_r")


def loops(steps: DataFrame) -> DataFrame:
    """One row per cycle of edit, failing verifications, edit, with nothing else of these two classes in between.

    steps: session_id, instr, k, cls, failed, context. The steps and input of a cycle run from its first edit to its
    last failing verification, whatever lies between. A cycle that begins with the edit that closed the one before is
    of the same chain. The pattern needs only the step before and the latest step that is no failing verification, both
    of which are running values, so that a long instruction is scanned in blocks and never gathered.
    """
    by, order = ["session_id", "instr"], ["k"]
    keep = [scale.BLOCK] if scale.BLOCK in steps.columns else []
    s = scale.scan(steps, by, order, _n=scale.row_index(), _in=scale.running_sum(F.col("context")))
    sym = F.when(F.col("cls") == "edit", "E").when(F.col("cls") == "verify", F.when(F.col("failed"), "F").otherwise("P"))
    s = s.withColumn("_s", sym).where("_s IS NOT NULL").select(*keep, *by, "k", "context", "_n", "_in", "_s")
    s = scale.scan(s, by, order, _fails=scale.running_sum((F.col("_s") == "F").cast("bigint")))
    s = s.withColumn("_at", F.struct("_s", "k", "_n", "_in", "_fails", "context"))
    s = scale.scan(s, by, order, _last=scale.previous(F.col("_at")),
                   _from=scale.last_known(F.when(F.col("_s") != "F", F.col("_at")), inclusive=False))
    s = s.where("_s = 'E' AND _last._s = 'F' AND _from._s = 'E'").select(
        *keep, *by, F.col("_from.k").alias("start_k"), F.col("_last.k").alias("failed_k"), "k",
        F.expr("_fails - _from._fails").alias("failures"), F.expr("_last._n - _from._n + 1").alias("steps"),
        F.expr("_last._in - _from._in + _from.context").alias("input"))
    s = scale.scan(s, by, order, _end=scale.previous(F.col("k")))
    s = s.withColumn("_new", F.coalesce(F.col("_end") != F.col("start_k"), F.lit(True)).cast("bigint"))
    return scale.scan(s, by, order, chain=scale.running_sum(F.col("_new"))).withColumnRenamed("k", "end_k").drop("_end", "_new", *keep)


def polling_runs(steps: DataFrame, least: int = 2) -> DataFrame:
    """Runs of at least `least` polling steps in a row in one instruction: steps, input, polls that showed the same as
    the one before, and what one call instead of the run would save."""
    by, order = ["session_id", "instr"], ["k"]
    poll = F.col("cls") == "poll"
    s = scale.scan(steps, by, order, _prev=scale.previous(F.struct("cls", "seen")))
    first = poll & ~F.coalesce(F.col("_prev.cls") == "poll", F.lit(False))
    s = s.withColumns({"_first": first.cast("bigint"), "_same": (~first & F.col("seen").eqNullSafe(F.col("_prev.seen"))).cast("bigint")})
    s = scale.scan(s, by, order, run=scale.running_sum(F.col("_first"))).where(poll)
    runs = s.groupBy(*by, "run").agg(F.min("k").alias("start_k"), F.count(F.lit(1)).alias("steps"), F.sum("context").alias("input"), F.sum("_same").alias("identical"))
    return runs.where(F.col("steps") >= least).withColumn("saved", F.col("input") * (F.col("steps") - 1) / F.col("steps")).drop("run")
