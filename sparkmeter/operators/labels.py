"""Instruction items, blind labelling samples, machine labels and agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import scale
from ..functions import text as tx
from ..functions.numbers import collapse_tool
from ..sources.agent_logs import ORDER, block_type, line_text

# --- fixed values ---------------------------------------------------------------------------
CATEGORIES = ("W1", "W2", "W3", "W4", "W5", "W6", "W7", "W8")
CHOICES = ("yes", "no", "unsure")
OUTCOMES = ("met", "partial", "not_met", "unsure")
MACHINE = {"t1": ("W1", "W2", "W6"), "t2": ("W4", "W5", "W8")}
KAPPA_MIN = 0.70
MAX_STEPS = 60
MAX_INSTRUCTION, MAX_FINAL = 4000, 1500
TARGET_KEYS = ("file_path", "path", "notebook_path", "command", "pattern", "url", "query", "description", "prompt", "skill")
SEED = 20261006
# ---------------------------------------------------------------------------------------------
ITEM = ["session_id", "instr"]


def tool_target(arg):
    """What a tool call acted on, in one short line. arg: input as VARIANT."""
    named = [F.nullif(F.try_variant_get(arg, f"$.{k}", "string"), F.lit("")) for k in TARGET_KEYS]
    values = F.map_values(F.try_variant_get(arg, "$", "map<string,variant>"))
    texts = F.filter(F.transform(F.filter(values, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: F.try_variant_get(v, "$", "string")), lambda s: F.trim(s) != "")
    return F.coalesce(tx.shorten(F.coalesce(*named, F.try_element_at(texts, F.lit(1))), 120), F.lit(""))


def _cut(text, n: int):
    t = F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")
    return F.when(F.length(t) <= n, t).otherwise(F.concat(F.substring(t, 1, n - 1), F.lit("…")))


def instruction_stats(calls: DataFrame, uses: DataFrame) -> DataFrame:
    """(session_id, instr, calls, input, output, errors, subagents) of the main chain."""
    c = calls.where("ctx_key = 'main' AND instr >= 1").groupBy(*ITEM).agg(F.count(F.lit(1)).alias("calls"), F.sum("context").alias("input"), F.sum("output").alias("output"))
    u = uses.where("ctx_key = 'main' AND instr >= 1").groupBy(*ITEM).agg(F.sum(F.col("is_error").cast("bigint")).alias("errors"), F.count(F.when(F.col("name").isin("Task", "Agent"), 1)).alias("subagents"))
    return c.join(u, ITEM, "full").fillna(0)


def instruction_items(indexed: DataFrame, uses: DataFrame, calls: DataFrame) -> DataFrame:
    """One item per real user message: prompt, the first 60 steps (how many more), last text, stats."""
    prompts = indexed.where("is_instr").select(*ITEM, _cut(line_text(), MAX_INSTRUCTION).alias("instruction"))
    main = uses.where("ctx_key = 'main' AND instr >= 1")
    arg = F.try_parse_json("input_sig")
    step = F.struct(collapse_tool("name").alias("tool"), tool_target(arg).alias("target"), F.length("result_text").alias("result_chars"), F.col("is_error").alias("error"))
    w = Window.partitionBy(*ITEM).orderBy(*ORDER, "bpos")  # rank <= 60 is pushed below the shuffle
    top = main.select(*ITEM, *ORDER, "bpos", step.alias("step")).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= MAX_STEPS)
    steps = top.groupBy(*ITEM).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "step"))), lambda e: e["step"]).alias("steps"))
    count = main.groupBy(*ITEM).agg(F.count(F.lit(1)).alias("n_steps"))
    b = F.col("b")
    said = indexed.where("type = 'assistant' AND NOT is_side AND instr >= 1").select(*ITEM, *ORDER, F.posexplode("blocks").alias("bpos", "b"))
    said = said.select(*ITEM, *ORDER, "bpos", F.when(block_type(b) == "text", F.try_variant_get(b, "$.text", "string")).alias("t")).where(F.trim("t") != "")
    final = said.groupBy(*ITEM).agg(F.max_by(_cut("t", MAX_FINAL), F.struct(*ORDER, "bpos")).alias("final"))
    out = prompts.join(steps, ITEM, "left").join(count, ITEM, "left").join(final, ITEM, "left").join(instruction_stats(calls, uses), ITEM, "left")
    out = out.fillna(0, ["n_steps", "calls", "input", "output", "errors", "subagents"])
    return out.withColumn("more_steps", F.greatest(F.lit(0), F.col("n_steps") - MAX_STEPS))


def sampling_frame(items: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
    """(session_id, instr, idx, stratum): instructions with calls, in thirds of input within the session.
    idx counts those only. exclude: (session_id, idx) already shown."""
    p = items.where("calls > 0")
    p = scale.scan(p, ["session_id"], ["instr"], idx=scale.row_index())
    r = scale.value_ranks(p, ["session_id"], "input")
    third, two = F.floor(F.col("total") / 3), F.floor(F.col("total") * 2 / 3)
    cuts = r.groupBy("session_id").agg(scale.at_rank("input", third).alias("t1"), scale.at_rank("input", two).alias("t2"))
    p = p.join(cuts, "session_id")
    size = F.when(F.col("input") < F.col("t1"), "s").when(F.col("input") < F.col("t2"), "m").otherwise("l")
    p = p.withColumn("stratum", F.concat_ws("|", F.col("session_id").cast("string"), size)).drop("t1", "t2")
    return p if exclude is None else p.join(exclude, ["session_id", "idx"], "left_anti")


def allocate(sizes: DataFrame, n: int) -> DataFrame:
    """(stratum, size) -> quota: proportional with largest remainders, never more than a stratum holds."""
    total = sizes.agg(F.sum("size").alias("total"))
    s = sizes.join(F.broadcast(total))  # one row
    raw = F.lit(n) * F.col("size") / F.col("total")
    s = s.withColumns({"base": F.least("size", F.floor(raw)), "rem": raw - F.floor(raw)})
    # hand the left-over places to the largest remainders; strata without room are passed over
    room = s.withColumn("open", (F.col("size") > F.col("base")).cast("bigint")).withColumn("_k", -F.col("rem"))
    given = s.agg((F.lit(n) - F.sum("base")).alias("spare"))
    room = room.withColumn(scale.BLOCK, F.floor(F.col("_k") * 256).cast("int")).withColumn("_h", F.expr("transform(split(stratum, ''), c -> -ascii(c))"))
    room = scale.scan(room, [], ["_k", "_h"], before=scale.running_sum(F.col("open"), inclusive=False)).drop(scale.BLOCK)
    room = room.join(F.broadcast(given))  # one row
    extra = F.when((F.col("open") == 1) & (F.col("before") < F.col("spare")), 1).otherwise(0)
    return room.select("stratum", "size", F.when(F.col("total") <= n, F.col("size")).otherwise(F.col("base") + extra).cast("bigint").alias("quota"))


def _draw(frame: DataFrame, n: int, tag: str) -> DataFrame:
    q = allocate(frame.groupBy("stratum").agg(F.count(F.lit(1)).alias("size")), n)
    w = Window.partitionBy("stratum").orderBy("_o")
    cap = frame.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)  # a quota never exceeds n
    return cap.join(q.select("stratum", "quota"), "stratum").where(F.col("_r") <= F.col("quota")).select("session_id", "idx", F.lit(tag).alias("part"))


def packet(items: DataFrame, n: int = 200, calibration: int = 20, seed: int = SEED, exclude: DataFrame | None = None) -> DataFrame:
    """(item_id, part, session_id, idx, instr, stratum): calibration items drawn first, the main sample from the
    rest. Order inside a stratum is a hash of seed and item, so the draw does not depend on partitioning."""
    frame = sampling_frame(items, exclude).withColumn("_o", F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("session_id").cast("string"), F.col("idx").cast("string")), 256))
    frame = scale.materialize(frame.select("session_id", "idx", "instr", "stratum", "_o"))  # drawn from twice
    cal = _draw(frame, calibration, "calibration")
    rest = frame.join(cal.select("session_id", "idx"), ["session_id", "idx"], "left_anti")
    picked = cal.unionByName(_draw(rest, n, "main"))
    out = frame.select("session_id", "idx", "instr", "stratum", F.concat(F.lit("i"), F.substring("_o", 1, 10)).alias("item_id"))
    return out.join(picked, ["session_id", "idx"])


def redact_items(items: DataFrame, patterns: list[str]) -> DataFrame:
    """Every text column, and the step targets, with the patterns masked."""
    fixed = {c: tx.redact(c, patterns) for c, t in items.dtypes if t == "string"}
    if "steps" in items.columns:
        fixed["steps"] = F.transform("steps", lambda s: s.withField("target", tx.redact(s["target"], patterns)))
    return items.withColumns(fixed)


def bad_cells(labels: DataFrame) -> DataFrame:
    """labels: (item, category, choice). Cells whose category or choice is not allowed."""
    c, v = F.col("category"), F.col("choice")
    ok = (c.isin(*CATEGORIES) & (v.isNull() | v.isin(*CHOICES))) | ((c == "outcome") & (v.isNull() | v.isin(*OUTCOMES)))
    return labels.where(~ok).select(F.concat_ws(".", F.col("item").cast("string"), "category").alias("error"))


def machine_labels(picked: DataFrame, flags: DataFrame, tier: str = "t1") -> DataFrame:
    """(item_id, category, choice): yes where the judge flagged the item's instruction. flags: (session_id, instr, category)."""
    cats = F.array(*[F.lit(c) for c in MACHINE[tier]])
    rows = picked.select("item_id", "session_id", "instr", F.explode(cats).alias("category"))
    hit = flags.select("session_id", "instr", "category").distinct().withColumn("_y", F.lit(True))
    return rows.join(hit, ["session_id", "instr", "category"], "left").select("item_id", "category", F.when(F.col("_y"), "yes").otherwise("no").alias("choice"))


def items_without_transcript(picked: DataFrame, frame: DataFrame) -> DataFrame:
    return picked.join(frame.select("session_id", "idx"), ["session_id", "idx"], "left_anti")


def kappa(pairs: DataFrame, by: list[str]) -> DataFrame:
    """pairs: (by, a, b). n, agree_pct and Cohen's kappa (null when chance agreement is 1)."""
    joint = pairs.groupBy(*by, "a", "b").agg(F.count(F.lit(1)).alias("n"))
    tot = joint.groupBy(*by).agg(F.sum("n").alias("total"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    ma = joint.groupBy(*by, F.col("a").alias("v")).agg(F.sum("n").alias("na"))
    mb = joint.groupBy(*by, F.col("b").alias("v")).agg(F.sum("n").alias("nb"))
    pe = ma.join(mb, [*by, "v"]).groupBy(*by).agg(F.sum(F.col("na") * F.col("nb")).alias("chance"))
    k = tot.join(pe, by, "left") if by else tot.join(F.broadcast(pe))  # one row each without keys
    po = F.col("same") / F.col("total")
    e = F.coalesce("chance", F.lit(0)) / (F.col("total") * F.col("total"))
    return k.select(*by, F.col("total").alias("n"), (100 * po).alias("agree_pct"), F.when(e < 1, (po - e) / (1 - e)).alias("kappa"))


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """a, b: (packet, phase, item, category, choice) of two coders. Per category n, agreement, kappa, pass."""
    x = a.where("choice IS NOT NULL").select("packet", "phase", "item", "category", F.col("choice").alias("a"))
    y = b.where("choice IS NOT NULL").select("packet", "phase", "item", "category", F.col("choice").alias("b"))
    k = kappa(x.join(y, ["packet", "phase", "item", "category"]), ["category"])
    return k.withColumn("passes", F.when(F.col("category") != "outcome", F.coalesce(F.col("kappa") >= KAPPA_MIN, F.lit(False))))


def disagreements(a: DataFrame, b: DataFrame) -> DataFrame:
    x = a.where("choice IS NOT NULL").select("packet", "phase", "item", "category", F.col("choice").alias("a"))
    y = b.where("choice IS NOT NULL").select("packet", "phase", "item", "category", F.col("choice").alias("b"))
    return x.join(y, ["packet", "phase", "item", "category"]).where("a <> b").select("category", "item", "a", "b")


def check_same_packet(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows saying what differs between two label files (packet, phase); empty when comparable."""
    def tag(df, side):
        return df.select("packet", "phase").distinct().withColumn("side", F.lit(side))

    t = tag(a, "a").unionByName(tag(b, "b"))
    return t.agg(F.count_distinct("packet").alias("p"), F.count_distinct("phase").alias("f")).select(
        F.explode(F.array_compact(F.array(F.when(F.col("p") > 1, "packet"), F.when(F.col("f") > 1, "phase")))).alias("error"))
