"""Agent transcripts: tolerant line scan, then one indexed silver table every analyser shares.

Order inside a session is (at, rank, pos): ``pos`` is the line's place in its file; sessions that
have sub-agent files are merged by time, so ``at`` is the last known time there and ``pos``
elsewhere; ``rank`` is 0 for the main file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scale
from ..functions import text as tx

ORDER = ["at", "rank", "pos"]
WRITERS = ["Edit", "Write", "MultiEdit", "NotebookEdit"]


# ---------------------------------------------------------------- scan


def read_agent_logs(spark: SparkSession, paths: list[str], since: str | None = None, hot_rows: int = scale.HOT_MIN_ROWS) -> DataFrame:
    """Raw lines of ``*.jsonl`` files: (session_id, file, at, rank, pos, value), in blocks where a session is large.

    ``since`` keeps files modified after that time (the reader prunes them before opening).
    """
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl")
    if since:
        reader = reader.option("modifiedAfter", since)
    path = F.col("_metadata.file_path")
    # rows of one split are numbered in file order; a split holds fewer lines than bytes, so adding
    # its start offset keeps the whole file in order
    pos = F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    raw = reader.text(paths).select("value", path.alias("file"), pos.alias("pos"))
    side = F.regexp_extract("file", r"^(.*)/subagents/[^/]+\.jsonl\z", 1)
    raw = raw.withColumn("session_id", F.when(side != "", side).otherwise(F.regexp_replace("file", r"\.jsonl\z", "")))
    return scale.with_blocks(merge_subagents(raw), ["session_id"], "at", hot_rows)


def merge_subagents(raw: DataFrame) -> DataFrame:
    """Give every line its merged order. A line without a time inherits the last one of its file."""
    is_side = F.col("file").contains("/subagents/")
    merged = raw.where(is_side).select("session_id").distinct().withColumn("_merged", F.lit(True))
    files = raw.where(is_side).select("session_id", "file").distinct()
    # ranks: sub-agent files are few per session, and only their names are ordered here
    ranks = scale.scan(files, ["session_id"], ["file"], rank=scale.row_index()).withColumn("rank", F.col("rank") + 1)
    stamp = F.unix_micros(tx.parse_time(F.try_variant_get(F.try_parse_json("value"), "$.timestamp", "string")))
    df = raw.join(merged, "session_id", "left").join(ranks, ["session_id", "file"], "left")
    df = df.withColumn("rank", F.coalesce("rank", F.lit(0))).withColumn("_t", F.when(F.col("_merged"), stamp))
    df = scale.with_blocks(df, ["file"], "pos")
    df = scale.scan(df, ["file"], ["pos"], _last=scale.last_known(F.col("_t"))).drop(scale.BLOCK)
    at = F.when(F.col("_merged"), F.coalesce("_last", F.lit(0))).otherwise(F.col("pos"))
    return df.withColumn("at", at).select("session_id", "file", "at", "rank", "pos", "value")


# ---------------------------------------------------------------- parse and index


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _flag(flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False))


def _count(count: Column) -> Column:
    return F.coalesce(count, F.lit(0))


#: What is read of a line, by one cast: fields that are missing or of another kind are null, one by one.
LINE = """struct<type string, subtype string, sessionId string, isSidechain boolean, agentId string, isMeta boolean, isCompactSummary boolean,
timestamp string, requestId string, uuid string, message struct<id string, model string, usage struct<input_tokens bigint, cache_read_input_tokens bigint,
cache_creation_input_tokens bigint, output_tokens bigint, cache_creation struct<ephemeral_1h_input_tokens bigint>>>>"""


def block_type(b: Column) -> Column:
    return F.try_variant_get(b, "$.type", "string")


def parse_lines(raw: DataFrame) -> DataFrame:
    """Typed columns; lines that are not JSON objects are dropped next to the scan."""
    v, r = F.col("_v"), F.col("_r")
    keep = [c for c in ("session_id", "at", "rank", "pos", scale.BLOCK) if c in raw.columns]
    # a filter on what explode gives stays above it, so each line is parsed once
    df = raw.select(*keep, F.explode(F.array(F.try_parse_json("value"))).alias("_v")).where(_get(v, "$", "struct<>").isNotNull())
    df = df.withColumn("_r", _get(v, "$", LINE))
    m, u = r["message"], r["message"]["usage"]
    blocks = _get(v, "$.message.content", "array<variant>")
    df = df.select(
        *keep,
        r["type"].alias("type"), r["subtype"].alias("subtype"), r["sessionId"].alias("log_session_id"),
        _flag(r["isSidechain"]).alias("is_side"), F.coalesce(r["agentId"], F.lit("")).alias("agent_id"),
        _flag(r["isMeta"]).alias("is_meta"), _flag(r["isCompactSummary"]).alias("is_summary"),
        tx.parse_time(r["timestamp"]).alias("ts"),
        m.isNotNull().alias("has_message"), u.isNotNull().alias("has_usage"),
        F.coalesce(m["id"], r["requestId"], r["uuid"]).alias("msg_key"), m["model"].alias("model"),
        _count(u["input_tokens"]).alias("input"), _count(u["cache_read_input_tokens"]).alias("cache_read"),
        _count(u["cache_creation_input_tokens"]).alias("cache_write"),
        _count(u["cache_creation"]["ephemeral_1h_input_tokens"]).alias("_1h"), _count(u["output_tokens"]).alias("output"),
        F.when(v.isNotNull(), blocks).alias("blocks"), "_v",
    ).withColumn("plain", F.when(F.col("blocks").isNull(), _get(v, "$.message.content", "string"))).drop("_v")
    return df.withColumns({
        "cache_write_1h": F.least("cache_write", "_1h"),
        "context": F.col("input") + F.col("cache_read") + F.col("cache_write"),
        "ctx_key": F.when(F.col("is_side"), F.concat(F.lit("side:"), "agent_id")).otherwise("main"),
        "is_boundary": F.coalesce((F.col("type") == "system") & (F.col("subtype") == "compact_boundary"), F.lit(False)),
        "is_instr": is_instruction(),
    }).drop("_1h")


def line_text() -> Column:
    """Text blocks joined by a space; the plain string when content is one."""
    texts = F.transform(F.filter("blocks", lambda b: block_type(b) == "text"),
                        lambda b: F.coalesce(F.try_variant_get(b, "$.text", "string"), F.lit("")))
    return F.coalesce(F.array_join(texts, " "), F.col("plain"), F.lit(""))


def is_instruction() -> Column:
    text = line_text()
    answered = F.coalesce(F.exists("blocks", lambda b: block_type(b) == "tool_result"), F.lit(False))
    real = (F.trim(F.regexp_replace(text, r"(?U)\s+", " ")) != "") & ~F.substring(text, 1, 200).contains("<system-reminder>") \
        & ~text.rlike(r"(?U)^\s*<")
    who = (F.col("type") == "user") & F.col("has_message") & ~F.col("is_side") & ~F.col("is_meta") & ~F.col("is_summary")
    return F.coalesce(who & ~answered & real, F.lit(False))


def index_lines(lines: DataFrame, audit_mode: bool = False, rows: int | None = None) -> DataFrame:
    """Place every line on the call axis.

    is_call: first line of a response that reported usage (one response is written as several
    lines repeating it). Responses without processed input are not calls, except in
    ``audit_mode``. call_k: dense index of the response's call in its context. main_calls:
    main-chain calls so far, this line included. epoch, instr: compactions and instructions so far.
    rows: about how many lines there are, if known; then no task holds more of them where there are more.
    """
    home = ["session_id"] + ([scale.BLOCK] if scale.BLOCK in lines.columns else [])
    df = lines.repartition(*home) if rows is None else scale.grouped(lines, home, rows)  # every window below is inside a session: one shuffle
    answer = (F.col("type") == "assistant") & F.col("has_message")
    df = scale.scan(df, ["session_id", "ctx_key", "msg_key"], ORDER,
                    _nth=scale.running_sum((answer & F.col("has_usage")).cast("bigint")))
    first = answer & F.col("has_usage") & (F.col("_nth") == 1)
    df = df.withColumn("is_call", F.coalesce(first if audit_mode else first & (F.col("context") > 0), F.lit(False)))
    df = scale.scan(df, ["session_id", "ctx_key"], ORDER, _calls=scale.running_sum(F.col("is_call").cast("bigint")))
    df = scale.scan(df, ["session_id", "ctx_key", "msg_key"], ORDER,
                    call_k=scale.last_known(F.when(F.col("is_call"), F.col("_calls") - 1)))
    main = (F.col("is_call") & ~F.col("is_side")).cast("bigint")
    df = scale.scan(df, ["session_id"], ORDER, main_calls=scale.running_sum(main),
                    instr=scale.running_sum(F.col("is_instr").cast("bigint")))
    compacts = F.col("is_boundary")
    if audit_mode:  # a summary is a compaction too, unless one is already marked at its call index
        mark = (F.col("is_boundary") | F.col("is_summary")).cast("bigint")
        df = scale.scan(df, ["session_id", "main_calls"], ORDER, _marks=scale.running_sum(mark, inclusive=False))
        compacts = compacts | (F.col("is_summary") & (F.coalesce("_marks", F.lit(0)) == 0))
    df = scale.scan(df, ["session_id"], ORDER, epoch=scale.running_sum(compacts.cast("bigint")))
    return df.withColumnRenamed("_calls", "ctx_calls").drop("_nth", "_marks")


def main_chain(df: DataFrame) -> DataFrame:
    """Rows of the main chain. Sub-agents have contexts of their own, in which calls count from 0 again.

    A frame that tells of no contexts at all is one chain; one that marks side calls must name their contexts.
    """
    if "ctx_key" in df.columns:
        return df.where("ctx_key = 'main'")
    if "is_side" in df.columns:
        raise ValueError("calls marked is_side need ctx_key, the context they belong to")
    return df


# ---------------------------------------------------------------- silver tables


def calls(indexed: DataFrame) -> DataFrame:
    keep = ["session_id", "ctx_key", "is_side", F.col("call_k").alias("k"), *ORDER, "ts", "model", "epoch", "instr",
            "input", "cache_read", "cache_write", "cache_write_1h", "output", "context"]
    keep += [scale.BLOCK] if scale.BLOCK in indexed.columns else []
    return indexed.where("is_call").select(*keep)


def compactions(indexed: DataFrame, mode: str = "bound") -> DataFrame:
    """(session_id, at_call). ``bound``: boundaries only, one per call index. ``audit``: also a
    summary line unless the last entry is already at that index. ``all``: every boundary."""
    at = indexed.select("session_id", *ORDER, F.col("main_calls").alias("at_call"), "is_boundary", "is_summary")
    marks = at.where("is_boundary").select("session_id", "at_call")
    if mode == "all":
        return marks
    if mode == "bound":
        return marks.distinct()
    # summaries at an index that has a boundary are skipped; several summaries at one index count once
    extra = at.where("is_summary AND NOT is_boundary").select("session_id", "at_call").distinct()
    return marks.unionByName(extra.join(marks.distinct(), ["session_id", "at_call"], "left_anti"))


def instructions(indexed: DataFrame) -> DataFrame:
    """(session_id, instr 1-based, start_k): the call index at which each instruction begins."""
    return indexed.where("is_instr").select("session_id", "instr", F.col("main_calls").alias("start_k"), *ORDER)


def snapshot(indexed: DataFrame, limits: DataFrame) -> DataFrame:
    """Lines before the (limit+1)-th instruction or main call. limits: (session_id, max_instr, max_calls),
    a null limit does not cut."""
    stop = indexed.join(limits, "session_id").where(
        (F.col("is_instr") & (F.col("instr") > F.col("max_instr")))
        | (F.col("is_call") & ~F.col("is_side") & (F.col("main_calls") > F.col("max_calls"))))
    stop = stop.groupBy("session_id").agg(F.min(F.struct(*ORDER)).alias("_stop"))
    out = indexed.join(stop, "session_id", "left")
    return out.where(F.col("_stop").isNull() | (F.struct(*ORDER) < F.col("_stop"))).drop("_stop")


def _first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key, combined on the map side."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return picked.select(*keys, "_r.*")


def text_of(content: Column) -> Column:
    """Plain string, or text blocks joined by newlines."""
    items = F.try_variant_get(content, "$", "array<variant>")
    texts = F.transform(F.filter(items, lambda b: block_type(b) == "text"),
                        lambda b: F.coalesce(F.try_variant_get(b, "$.text", "string"), F.lit("")))
    return F.when(items.isNotNull(), F.array_join(texts, "\n")).otherwise(
        F.coalesce(F.try_variant_get(content, "$", "string"), F.lit("")))


def spaced_json(json: Column) -> Column:
    """Compact JSON text with a blank behind each comma and colon that stands outside strings."""
    quote, backslash = "\ufdd0", "\ufdd1"  # escapes are put aside, so that quotes alternate between opening and closing
    masked = F.replace(F.replace(json, F.lit("\\\\"), F.lit(backslash)), F.lit('\\"'), F.lit(quote))
    parts = F.transform(F.split(masked, '"'), lambda x, i: F.when(i % 2 == 0, F.regexp_replace(x, "([,:])", "$1 ")).otherwise(x))
    return F.replace(F.replace(F.array_join(parts, '"'), F.lit(quote), F.lit('\\"')), F.lit(backslash), F.lit("\\\\"))


def tool_uses(indexed: DataFrame) -> DataFrame:
    """One row per tool use with its first result. Uses without a result are kept."""
    uses, res = _uses(indexed), _results(indexed, first=True)
    res = res.select("session_id", "use_id", *[F.struct(*ORDER, "bpos").alias("result_ord")], *[c for c in RESULT + ["result_blk"] if c in res.columns])
    out = uses.join(res, ["session_id", "use_id"], "left")
    return out.withColumns({
        "has_result": F.col("result_ord").isNotNull(),
        "is_error": F.coalesce("is_error", F.lit(False)),
        "images": F.coalesce("images", F.lit(0)),
        "result_tokens": F.coalesce("result_tokens", F.lit(0)),
        "text_tokens": F.coalesce("text_tokens", F.lit(0)),
    })


def orphan_results(indexed: DataFrame) -> DataFrame:
    """Results whose use is not in the session's log, shaped as tool_uses() without what only a use says.

    They take part in no pairing, but an error among them is a failure all the same.
    """
    known = _uses(indexed).select("session_id", "use_id")
    rows = _results(indexed).join(known, ["session_id", "use_id"], "left_anti")
    return rows.select("session_id", "use_id", "ctx_key", "is_side", F.struct(*ORDER, "bpos").alias("result_ord"), *[c for c in RESULT + ["result_blk"] if c in rows.columns]).withColumn("has_result", F.lit(True))


def _uses(indexed: DataFrame) -> DataFrame:
    b = F.col("b")
    carry = ["session_id", "ctx_key", "is_side", *ORDER, "epoch", "instr", "main_calls", "ctx_calls", "call_k"]
    carry += [scale.BLOCK] if scale.BLOCK in indexed.columns else []
    uses = indexed.where((F.col("type") == "assistant") & F.col("blocks").isNotNull()).select(
        *carry, F.posexplode("blocks").alias("bpos", "b"))
    use_id = F.try_variant_get(b, "$.id", "string")
    uses = uses.where((block_type(b) == "tool_use") & use_id.isNotNull()).withColumn("use_id", use_id)
    uses = _first_by(uses, ["session_id", "use_id"], [*ORDER, "bpos"])  # told of the first only, and only what is asked for
    arg = F.try_variant_get(b, "$.input", "variant")
    uses = uses.select(
        *carry, "bpos", "use_id",
        F.coalesce(F.try_variant_get(b, "$.name", "string"), F.lit("?")).alias("name"),
        F.to_json(arg).alias("input_sig"),  # object keys come back sorted
        F.coalesce(F.try_variant_get(b, "$.input.file_path", "string"), F.try_variant_get(b, "$.input.path", "string"),
                   F.try_variant_get(b, "$.input.notebook_path", "string")).alias("path"),
        F.to_json(F.struct(F.try_variant_get(b, "$.input.offset", "string"), F.try_variant_get(b, "$.input.limit", "string"),
                           F.try_variant_get(b, "$.input.pages", "string"))).alias("read_range"),
        F.try_variant_get(b, "$.input.command", "string").alias("command"),
        F.coalesce(F.try_variant_get(b, "$.input.content", "string"), F.try_variant_get(b, "$.input.new_string", "string"),
                   F.try_variant_get(b, "$.input.new_source", "string"), F.lit("")).alias("body"),
    )
    return uses.withColumn("k", F.greatest(F.lit(0), F.col("main_calls") - 1))


#: What a result tells, beside its place.
RESULT = ["result_epoch", "result_instr", "result_at", "result_ctx_at", "is_error", "result_tokens", "text_tokens", "images", "result_hash", "result_text"]


def _results(indexed: DataFrame, first: bool = False) -> DataFrame:
    """Tool results, all or the first of each use."""
    b = F.col("b")
    result_block = [F.col(scale.BLOCK).alias("result_blk")] if scale.BLOCK in indexed.columns else []
    res = indexed.where((F.col("type") == "user") & F.col("blocks").isNotNull()).select(
        "session_id", "ctx_key", "is_side", *ORDER, "epoch", "instr", "main_calls", "ctx_calls", *([scale.BLOCK] if result_block else []), F.posexplode("blocks").alias("bpos", "b"))
    content = F.try_variant_get(b, "$.content", "variant")
    items = F.try_variant_get(content, "$", "array<variant>")
    by_block = F.aggregate(
        F.filter(items, lambda x: block_type(x) == "text"), F.lit(0).cast("bigint"),
        lambda acc, x: acc + tx.estimate_tokens(F.coalesce(F.try_variant_get(x, "$.text", "string"), F.lit(""))))
    joined = F.array_join(F.transform(items, lambda x: F.coalesce(F.try_variant_get(x, "$.text", "string"), F.lit(""))), "\n")
    whole = F.when(items.isNotNull(), joined).otherwise(F.coalesce(F.try_variant_get(content, "$", "string"), F.lit("")))
    res = res.where(block_type(b) == "tool_result").withColumn("use_id", F.try_variant_get(b, "$.tool_use_id", "string"))
    if first:
        res = _first_by(res, ["session_id", "use_id"], [*ORDER, "bpos"])
    return res.select(
        "session_id", "ctx_key", "is_side", "use_id", *ORDER, "bpos",
        F.col("epoch").alias("result_epoch"), F.col("instr").alias("result_instr"),
        F.col("main_calls").alias("result_at"), F.col("ctx_calls").alias("result_ctx_at"), *result_block,
        F.coalesce(F.try_variant_get(b, "$.is_error", "boolean"), F.lit(False)).alias("is_error"),
        F.when(items.isNotNull(), by_block).otherwise(tx.estimate_tokens(whole)).alias("result_tokens"),
        tx.estimate_tokens(whole).alias("text_tokens"),
        F.coalesce(F.size(F.filter(items, lambda x: block_type(x) == "image")), F.lit(0)).alias("images"),
        F.sha2(F.to_json(content), 256).alias("result_hash"),
        text_of(content).alias("result_text"),
    )


def segments(indexed: DataFrame) -> DataFrame:
    """Context pieces of the main chain: (session_id, seg_id, kind, tokens, birth, terms, epoch).

    Prompts, reminders, summaries and tool results are born at the next call; what call k wrote is
    born at k + 1. Thinking is left to the unattributed rest.
    """
    b = F.col("b")
    main = indexed.where(~F.col("is_side") & F.col("has_message"))
    own = F.array(F.to_variant_object(F.named_struct(F.lit("type"), F.lit("text"), F.lit("text"), F.col("plain"))))
    rows = main.select("session_id", *ORDER, "type", "is_meta", "is_summary", "main_calls", "call_k",
                       F.posexplode(F.coalesce("blocks", F.when(F.col("plain").isNotNull(), own))).alias("bpos", "b"))
    kind_of = block_type(b)
    raw_text = F.coalesce(F.try_variant_get(b, "$.text", "string"), F.lit(""))
    name = F.try_variant_get(b, "$.name", "string")
    wrote = F.when(kind_of == "text", raw_text).when(kind_of == "tool_use", F.to_json(F.try_variant_get(b, "$.input", "variant")))
    got = F.when(kind_of == "tool_result", text_of(F.try_variant_get(b, "$.content", "variant"))).when(kind_of == "text", raw_text)
    answer = (F.col("type") == "assistant") & F.col("call_k").isNotNull()
    user = F.col("type") == "user"
    rows = rows.select(
        "session_id", *ORDER, "bpos",
        F.when(answer, wrote).when(user, got).alias("raw"), (answer & (kind_of == "tool_use")).alias("is_json"),
        F.when(answer & (kind_of == "text"), "assistant_text")
        .when(answer & name.isin(WRITERS), "persisted_write")
        .when(answer & (kind_of == "tool_use"), "tool_input")
        .when(user & F.col("is_summary"), "compact_summary")
        .when(user & (kind_of == "tool_result"), "tool_result")
        .when(user & (F.col("is_meta") | raw_text.contains("<system-reminder>")), "harness")
        .when(user & (kind_of == "text"), "user_prompt").alias("kind"),
        F.when(answer, F.col("call_k") + 1).otherwise(F.col("main_calls")).alias("birth"),
        F.when(answer, F.col("call_k")).alias("out_k"),
    ).where("kind IS NOT NULL AND raw <> ''")  # only a text without characters has no tokens, so nothing is spaced or counted for a query that reads neither
    rows = rows.withColumn("text", F.when(F.col("is_json"), spaced_json(F.col("raw"))).otherwise(F.col("raw")))
    rows = rows.withColumns({"tokens": tx.estimate_tokens("text").cast("double"), "terms": tx.distinctive_terms("text"),
                             "seg_id": F.xxhash64("session_id", *ORDER, "bpos")})
    return rows.select("session_id", "seg_id", "kind", "tokens", "birth", "terms", "out_k")


def call_terms(segs: DataFrame) -> DataFrame:
    """(session_id, k, term): the distinctive terms each call's output contains."""
    out = segs.where("out_k IS NOT NULL").select("session_id", F.col("out_k").alias("k"), F.explode("terms").alias("term"))
    return out.distinct()


def written_tokens(uses: DataFrame) -> DataFrame:
    kept = uses.where(F.col("name").isin(WRITERS) & (F.col("ctx_key") == "main"))
    return kept.groupBy("session_id").agg(F.sum(tx.estimate_tokens("body")).alias("written_tokens"))


def output_terms(indexed: DataFrame) -> DataFrame:
    """(session_id, ctx_key, k, term) over every context, sub-agents included."""
    rows = indexed.where((F.col("type") == "assistant") & F.col("blocks").isNotNull() & F.col("call_k").isNotNull()).select(
        "session_id", "ctx_key", F.col("call_k").alias("k"), F.explode("blocks").alias("b"))
    b = F.col("b")
    text = F.when(block_type(b) == "text", F.try_variant_get(b, "$.text", "string")) \
        .when(block_type(b) == "tool_use", F.to_json(F.try_variant_get(b, "$.input", "variant")))
    return rows.select("session_id", "ctx_key", "k", F.explode(tx.distinctive_terms(text)).alias("term")).distinct()


def step_text(indexed: DataFrame) -> DataFrame:
    """(session_id, ctx_key, call_k, has_text): whether a response wrote any text."""
    wrote = F.exists("blocks", lambda b: (block_type(b) == "text") & (F.trim(F.coalesce(F.try_variant_get(b, "$.text", "string"), F.lit(""))) != ""))
    rows = indexed.where((F.col("type") == "assistant") & F.col("call_k").isNotNull())
    return rows.groupBy("session_id", "ctx_key", "call_k").agg(F.bool_or(F.coalesce(wrote, F.lit(False))).alias("has_text"))
