"""Log parsing end to end: the tables are written as transcript lines, exports, pages and streams of
chunks inside Spark, then read by the library's own parsers."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import functions as F

from .. import scale
from ..operators import audit, floor, labels, ledger, rules, survey
from ..sources import agent_logs as al
from ..sources import chats, event_pages, tables
from .registry import CALLS, query, with_views

L = F.lit


def _json(**fields):
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


LINES_PER_EVENT = 3  # raw_lines makes about so many


def uses_table(ix, *unread):
    """Tool uses, written once for queries that read them more than once, without the columns these do not read."""
    return scale.stored(al.tool_uses(ix).drop(*unread), "uses")


def raw_lines(spark, sf):
    """Each event as the lines a coding agent would have written for it."""
    c = tables.calls(spark, sf)
    item = F.regexp_extract("input_sig", r"([0-9]+)", 1)
    path = F.concat(L("/p/"), item)
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), L("Z"))
    sid = F.col("session_id").cast("string")
    mid, tid = F.concat(L("m"), F.col("event_id").cast("string")), F.concat(L("t"), F.col("event_id").cast("string"))
    usage = F.struct(F.col("input").alias("input_tokens"), F.col("cache_read").alias("cache_read_input_tokens"), F.col("cache_write").alias("cache_creation_input_tokens"),
                     F.struct(F.col("cache_write_1h").alias("ephemeral_1h_input_tokens")).alias("cache_creation"), F.col("output").alias("output_tokens"))
    args = F.struct(F.when(F.col("name").isin("Read", "Write"), path).alias("file_path"), F.when(F.col("name") == "Bash", F.concat(L("run "), item)).alias("command"),
                    F.when(F.col("name") == "Write", F.concat(L("body_of_"), item)).alias("content"), F.when(F.col("name").isin("Grep", "mcp__shop__buy"), item).alias("pattern"))
    use = F.struct(L("tool_use").alias("type"), tid.alias("id"), F.col("name"), args.alias("input"))
    said = F.struct(L("text").alias("type"), F.concat(L("Handled result_"), F.col("result_hash").cast("string"), L(" for item_number_"), item).alias("text"))
    answer = lambda block: F.struct(mid.alias("id"), L("assistant").alias("role"), F.col("model"), usage.alias("usage"), F.array(block).alias("content"))
    got = F.struct(L("tool_result").alias("type"), tid.alias("tool_use_id"), F.concat(L("result_"), F.col("result_hash").cast("string"), F.repeat(L("."), 3)).alias("content"), F.col("is_error"))
    lines = F.array(
        F.when(F.col("is_compact") == 1, _json(type=L("system"), subtype=L("compact_boundary"), sessionId=sid)),
        F.when(F.col("is_instr") == 1, _json(type=L("user"), sessionId=sid, timestamp=iso, message=F.struct(L("user").alias("role"), F.concat(L("Please do step "), F.col("event_id").cast("string")).alias("content")))),
        F.when(F.col("event_id") % 100 == 0, L('{"type": "broken')),
        _json(type=L("assistant"), sessionId=sid, timestamp=iso, message=answer(use)),
        _json(type=L("assistant"), sessionId=sid, timestamp=iso, message=answer(said)),
        F.when(F.col("event_id") % 17 != 0, _json(type=L("user"), sessionId=sid, timestamp=iso, message=F.struct(L("user").alias("role"), F.array(got).alias("content")))))
    c = c.select(sid.alias("session_id"), F.unix_micros("ts").alias("at"), "event_id", F.posexplode(lines).alias("p", "value")).where("value IS NOT NULL")
    return c.select("session_id", "at", L(0).cast("bigint").alias("rank"), (F.col("event_id") * 10 + F.col("p")).alias("pos"), "value")


def index(spark, sf, raw, audit_mode=False):
    return al.index_lines(al.parse_lines(raw), audit_mode, LINES_PER_EVENT * tables.events(spark, sf))


def indexed(spark, sf, audit_mode=False):
    return index(spark, sf, raw_lines(spark, sf), audit_mode)


def index_table(spark, sf, audit_mode=False):
    """The same, written once for queries that read it more than once."""
    return scale.stored(indexed(spark, sf, audit_mode), "index")


@query("log_calls", with_views(CALLS, "SELECT session_id::VARCHAR AS session_id, k, epoch, instr, context, CAST(cache_write_1h AS BIGINT) AS cache_write_1h, output, model FROM calls WHERE context > 0"))
def log_calls(spark, sf):
    return al.calls(indexed(spark, sf)).select("session_id", "k", "epoch", "instr", "context", "cache_write_1h", "output", "model")


@query("log_tool_uses", with_views(CALLS, """SELECT session_id::VARCHAR AS session_id, 't' || event_id AS use_id, name, k, has_result, is_error, CASE WHEN has_result THEN CAST(ceil((length('result_' || result_hash) + 3) / 4.0) AS BIGINT) ELSE 0 END AS result_tokens FROM tools"""))
def log_tool_uses(spark, sf):
    return al.tool_uses(index_table(spark, sf)).select("session_id", "use_id", "name", "k", "has_result", "is_error", "result_tokens")


@query("log_compactions", with_views(CALLS, "SELECT DISTINCT session_id::VARCHAR AS session_id, k AS at_call FROM calls WHERE is_compact = 1"))
def log_compactions(spark, sf):
    return al.compactions(indexed(spark, sf))


@query("log_instructions", with_views(CALLS, "SELECT session_id::VARCHAR AS session_id, instr, k AS start_k FROM calls WHERE is_instr = 1"))
def log_instructions(spark, sf):
    return al.instructions(indexed(spark, sf)).select("session_id", "instr", "start_k")


@query("log_snapshot", with_views(CALLS, "SELECT session_id::VARCHAR AS session_id, CAST(count(*) AS BIGINT) AS calls, CAST(sum(context) AS BIGINT) AS input FROM calls WHERE k < 20 AND instr <= 4 GROUP BY 1"))
def log_snapshot(spark, sf):
    """The first four instructions, at most twenty calls."""
    ix = index_table(spark, sf)
    limits = ix.select("session_id").distinct().select("session_id", L(4).alias("max_instr"), L(20).alias("max_calls"))
    return al.calls(al.snapshot(ix, limits)).groupBy("session_id").agg(F.count(L(1)).alias("calls"), F.sum("context").alias("input"))


@query("log_segments", with_views(CALLS, """SELECT session_id::VARCHAR AS session_id, kind, CAST(count(*) AS BIGINT) AS n FROM (SELECT session_id, 'user_prompt' AS kind FROM calls WHERE is_instr = 1 UNION ALL SELECT session_id, 'assistant_text' FROM calls
  UNION ALL SELECT session_id, CASE WHEN name = 'Write' THEN 'persisted_write' ELSE 'tool_input' END FROM calls UNION ALL SELECT session_id, 'tool_result' FROM tools WHERE has_result) GROUP BY 1, 2"""))
def log_segments(spark, sf):
    return al.segments(indexed(spark, sf)).groupBy("session_id", "kind").agg(F.count(L(1)).alias("n"))


@query("log_segment_births", with_views(CALLS, """SELECT session_id::VARCHAR AS session_id, birth, CAST(count(*) AS BIGINT) AS n FROM (SELECT session_id, k AS birth FROM calls WHERE is_instr = 1 UNION ALL SELECT session_id, k + 1 FROM calls UNION ALL SELECT session_id, k + 1 FROM calls
  UNION ALL SELECT session_id, k + 1 FROM tools WHERE has_result) GROUP BY 1, 2"""))
def log_segment_births(spark, sf):
    return al.segments(indexed(spark, sf)).groupBy("session_id", "birth").agg(F.count(L(1)).alias("n"))


@query("log_written_tokens", with_views(CALLS, "SELECT session_id::VARCHAR AS session_id, CAST(sum(ceil(length('body_of_' || substr(path, 4)) / 4.0)) AS BIGINT) AS written_tokens FROM tools WHERE name = 'Write' GROUP BY 1"))
def log_written_tokens(spark, sf):
    return al.written_tokens(al.tool_uses(index_table(spark, sf)))


@query("log_duplicate_results", with_views(CALLS, """SELECT session_id::VARCHAR AS session_id, use_id, category FROM (SELECT session_id, 't' || event_id AS use_id, CASE WHEN lag(result_hash) OVER w = result_hash AND lag(epoch) OVER w = epoch THEN 'W1' WHEN is_error THEN 'W2' END AS category
  FROM tools WHERE has_result WINDOW w AS (PARTITION BY session_id, name, regexp_extract(input_sig, '([0-9]+)', 1) ORDER BY k)) WHERE category IS NOT NULL"""))
def log_duplicate_results(spark, sf):
    return floor.judged_results(al.tool_uses(index_table(spark, sf))).where("category IS NOT NULL").select("session_id", "use_id", "category")


@query("log_failures_with_orphans", with_views(CALLS, """SELECT session_id::VARCHAR AS session_id, category, count(*) AS n, CAST(sum(orphan) AS BIGINT) AS orphans FROM (
  SELECT session_id, 0 AS orphan, CASE WHEN lag(result_hash) OVER w = result_hash AND lag(epoch) OVER w = epoch THEN 'W1' WHEN is_error THEN 'W2' END AS category
  FROM tools WHERE has_result WINDOW w AS (PARTITION BY session_id, name, regexp_extract(input_sig, '([0-9]+)', 1) ORDER BY k)
  UNION ALL SELECT session_id, 1, 'W2' FROM calls WHERE event_id % 46 = 0) WHERE category IS NOT NULL GROUP BY ALL"""))
def log_failures_with_orphans(spark, sf):
    """Beside every 23rd event a result whose use is in no line, every other one an error."""
    c = tables.calls(spark, sf).where("event_id % 23 = 0")
    sid, iso = F.col("session_id").cast("string"), F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), L("Z"))
    block = F.struct(L("tool_result").alias("type"), F.when(F.col("event_id") % 3 != 0, F.concat(L("gone"), F.col("event_id").cast("string"))).alias("tool_use_id"), (F.col("event_id") % 46 == 0).alias("is_error"), L("lost").alias("content"))
    line = _json(type=L("user"), sessionId=sid, timestamp=iso, message=F.struct(L("user").alias("role"), F.array(block).alias("content")))
    more = c.select(sid.alias("session_id"), F.unix_micros("ts").alias("at"), L(0).cast("bigint").alias("rank"), (F.col("event_id") * 10 - 1).alias("pos"), line.alias("value"))
    ix = scale.stored(index(spark, sf, raw_lines(spark, sf).unionByName(more)), "index")
    judged = floor.judged_results(al.tool_uses(ix), orphans=al.orphan_results(ix)).where("category IS NOT NULL")
    return judged.groupBy("session_id", "category").agg(F.count(L(1)).alias("n"), F.sum(F.col("name").isNull().cast("bigint")).alias("orphans"))


@query("log_audit", with_views(CALLS, "SELECT session_id::VARCHAR AS session_id, CAST(count(*) AS BIGINT) AS api_calls, CAST(sum(context) AS BIGINT) AS processed_input, max(context) AS peak_context FROM calls GROUP BY 1"))
def log_audit(spark, sf):
    ix = index_table(spark, sf, audit_mode=True)
    return audit.audit(al.calls(ix), al.tool_uses(ix)).select("session_id", "api_calls", "processed_input", "peak_context")


def with_side_lines(spark, sf):
    """The same lines with a sub-agent's answer beside every seventh event, and compactions that show only as a summary."""
    c = tables.calls(spark, sf)
    sid, iso = F.col("session_id").cast("string"), F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), L("Z"))
    usage = F.struct(L(7).alias("input_tokens"), (F.col("context") + 90_000).alias("cache_read_input_tokens"), L(0).alias("cache_creation_input_tokens"), L(5).alias("output_tokens"))
    said = F.struct(L("text").alias("type"), L("aside").alias("text"))
    message = F.struct(F.concat(L("s"), F.col("event_id").cast("string")).alias("id"), L("assistant").alias("role"), F.col("model"), usage.alias("usage"), F.array(said).alias("content"))
    lines = F.array(
        F.when(F.col("event_id") % 70 == 35, _json(type=L("user"), sessionId=sid, timestamp=iso, isCompactSummary=L(True), message=F.struct(L("user").alias("role"), L("summary so far").alias("content")))),
        F.when(F.col("event_id") % 7 == 0, _json(type=L("assistant"), sessionId=sid, timestamp=iso, isSidechain=L(True), agentId=L("a1"), message=message)))
    more = c.select(sid.alias("session_id"), F.unix_micros("ts").alias("at"), "event_id", F.posexplode(lines).alias("p", "value")).where("value IS NOT NULL")
    # before the event's own lines
    more = more.select("session_id", "at", L(0).cast("bigint").alias("rank"), (F.col("event_id") * 10 - 2 + F.col("p")).alias("pos"), "value")
    return raw_lines(spark, sf).unionByName(more)


def side_index_table(spark, sf, audit_mode=False):
    return scale.stored(index(spark, sf, with_side_lines(spark, sf), audit_mode), "index")


SIDE = f"""{CALLS},
marked AS (SELECT *, CASE WHEN is_compact = 1 OR event_id % 70 = 35 THEN 1 ELSE 0 END AS cut FROM calls)"""


@query("log_audit_with_subagents", with_views(SIDE, """SELECT session_id::VARCHAR AS session_id, CAST(count(*) AS BIGINT) AS api_calls, CAST(sum(context) AS BIGINT) AS processed_input, max(context) AS peak_context,
  CAST(sum(cut) AS BIGINT) AS compactions, CAST(sum((event_id % 7 = 0)::INT) AS BIGINT) AS subagent_calls FROM marked GROUP BY 1"""))
def log_audit_with_subagents(spark, sf):
    """Sub-agent calls stay apart, and summaries without a boundary count as compactions."""
    ix = side_index_table(spark, sf, audit_mode=True)
    return audit.audit(al.calls(ix), al.tool_uses(ix)).select("session_id", "api_calls", "processed_input", "peak_context", "compactions", "subagent_calls")


@query("log_instructions_with_subagents", with_views(CALLS, "SELECT session_id::VARCHAR AS session_id, instr, CAST(count(*) AS BIGINT) AS calls, CAST(sum(context) AS BIGINT) AS input FROM calls WHERE instr >= 1 GROUP BY 1, 2"))
def log_instructions_with_subagents(spark, sf):
    return survey.per_instruction(al.calls(side_index_table(spark, sf)))


@query("log_measures_with_subagents", with_views(CALLS, """SELECT session_id::VARCHAR AS session_id, CAST(count(*) AS BIGINT) AS api_calls, CAST(sum(context) AS BIGINT) AS input_processed, max(context) AS peak_context, CAST(sum(cache_read) AS BIGINT) AS cache_read FROM calls GROUP BY 1"""))
def log_measures_with_subagents(spark, sf):
    ix = side_index_table(spark, sf)
    return survey.measure(al.calls(ix), al.tool_uses(ix), al.instructions(ix)).select("session_id", "api_calls", "input_processed", "peak_context", "cache_read")


@query("log_steps_on_waste")
def log_steps_on_waste(spark, sf):
    """No step here is without text, so each response is checked and none qualifies once text counts; the
    text flag is dropped to list the candidates."""
    ix = index_table(spark, sf)
    uses = uses_table(ix, "path", "read_range", "command", "body", "result_tokens", "text_tokens", "images", "result_text").withColumn("has_text", L(False))
    return floor.wasted_steps(floor.judged_results(uses), uses, al.calls(ix)).select("session_id", "call_k", "category", "input")


@query("log_response_text", with_views(CALLS, "SELECT session_id::VARCHAR AS session_id, CAST(count(*) AS BIGINT) AS n FROM calls GROUP BY 1"))
def log_response_text(spark, sf):
    return al.step_text(indexed(spark, sf)).where("has_text").groupBy("session_id").agg(F.count(L(1)).alias("n"))


@query("log_line_types", with_views(CALLS, """SELECT session_id::VARCHAR AS session_id, label, n, CAST(row_number() OVER (PARTITION BY session_id ORDER BY n DESC, label) AS INT) AS rank FROM (SELECT session_id, label, CAST(sum(c) AS BIGINT) AS n FROM (
  SELECT session_id, 'assistant' AS label, 2 AS c FROM calls UNION ALL SELECT session_id, 'user', is_instr + (event_id % 17 <> 0)::INT FROM calls UNION ALL SELECT session_id, 'system', is_compact FROM calls) GROUP BY 1, 2) WHERE n > 0"""))
def log_line_types(spark, sf):
    return survey.top_counts(al.parse_lines(raw_lines(spark, sf)), "type", 12)


@query("log_exploration")
def log_exploration(spark, sf):
    ix = index_table(spark, sf)
    uses = uses_table(ix, "input_sig", "read_range", "result_hash", "result_tokens", "text_tokens", "images")
    w8 = rules.over_exploration(rules.exploration(uses), scale.stored(al.output_terms(ix), "terms"))
    w4 = rules.discarded_output(rules.whole_file_writes(uses))
    w5 = w8.select("session_id", "instr", L(0.0).alias("w5"), L(0).alias("w5_input"))
    return rules.scores(al.instructions(ix), w4, w5, w8)


@query("log_term_reach", with_views(CALLS, r"""SELECT session_id::VARCHAR AS session_id, term, CAST(max(k) AS BIGINT) AS last_k FROM (SELECT DISTINCT session_id, k, unnest(regexp_extract_all('Handled result_' || result_hash || ' for item_number_' || regexp_extract(input_sig, '([0-9]+)', 1) || ' ' || CASE name WHEN 'Write' THEN 'body_of_' || regexp_extract(input_sig, '([0-9]+)', 1) || ' content file_path' WHEN 'Read' THEN 'file_path' WHEN 'Bash' THEN 'command' ELSE 'pattern' END, '[A-Za-z_][A-Za-z0-9_./\-]{5,}|[0-9]{4,}')) AS term FROM calls) JOIN (SELECT session_id, count(*) AS active FROM calls GROUP BY 1) USING (session_id)
  GROUP BY session_id, term, active HAVING count(*) <= greatest(3, 0.02 * active)"""))
def log_term_reach(spark, sf):
    return rules.term_reach(scale.stored(al.output_terms(indexed(spark, sf)), "terms")).select("session_id", "term", "last_k")


@query("log_instruction_items")
def log_instruction_items(spark, sf):
    ix = index_table(spark, sf)
    uses = uses_table(ix, "path", "read_range", "command", "body", "result_hash", "result_tokens", "text_tokens", "images")
    items = labels.instruction_items(ix, uses, al.calls(ix))
    return labels.redact_items(items, [r"/p/[0-9]+"])


@query("log_instruction_stats", with_views(CALLS, "SELECT session_id::VARCHAR AS session_id, instr, CAST(count(*) AS BIGINT) AS calls, CAST(sum(context) AS BIGINT) AS input, CAST(sum(CASE WHEN is_error AND event_id % 17 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS errors FROM calls WHERE instr >= 1 GROUP BY 1, 2"))
def log_instruction_stats(spark, sf):
    ix = index_table(spark, sf)
    return labels.instruction_stats(al.calls(ix), al.tool_uses(ix)).select("session_id", "instr", "calls", "input", "errors")


@query("merged_subagent_lines", """WITH e AS (SELECT user_id, event_id, event_id % 10 = 3 AS side, ts, event_id % 4 <> 0 AS timed FROM events),
f AS (SELECT *, max(CASE WHEN timed THEN epoch_us(ts) END) OVER (PARTITION BY user_id, side ORDER BY event_id) AS lt, bool_or(side) OVER (PARTITION BY user_id) AS merged FROM e)
SELECT user_id::VARCHAR AS session_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN merged THEN coalesce(lt, 0) ELSE event_id END, side, event_id) AS INT) AS place FROM f""")
def merged_subagent_lines(spark, sf):
    """Every tenth event sits in a sub-agent file; every fourth line has no time of its own."""
    from pyspark.sql import Window

    e = tables.load(spark, sf, "events")
    iso = F.when(F.col("event_id") % 4 != 0, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), L("Z")))
    name = F.col("user_id").cast("string")
    file = F.when(F.col("event_id") % 10 == 3, F.concat(name, L("/subagents/a.jsonl"))).otherwise(F.concat(name, L(".jsonl")))
    raw = e.select(name.alias("session_id"), file.alias("file"), F.col("event_id").alias("pos"), _json(id=F.col("event_id"), timestamp=iso).alias("value"))
    m = al.merge_subagents(raw)
    place = F.row_number().over(Window.partitionBy("session_id").orderBy(*al.ORDER))
    return m.select("session_id", F.col("pos").alias("event_id"), place.alias("place"))


@query("event_page_calls", """SELECT user_id::VARCHAR AS session_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS k, CAST(floor(value) AS BIGINT) + 1 AS context FROM events""")
def event_page_calls(spark, sf):
    """Pages of an event API: plain and wrapped, each event also repeated on the next page."""
    e = tables.load(spark, sf, "events")
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), L("Z"))
    eid = F.col("event_id").cast("string")
    msg = F.struct(F.concat(L("m"), eid).alias("id"), F.struct((F.floor("value") + 1).alias("input_tokens")).alias("usage"), F.array(F.struct(L("text").alias("type"), L("a {brace}\nline").alias("text"))).alias("content"))
    ev = F.struct(F.struct(F.concat(L("u"), eid).alias("uuid"), iso.alias("timestamp"), msg.alias("message")).alias("assistant"), iso.alias("created_at"))
    e = e.select(F.col("user_id").cast("string").alias("session_id"), ev.alias("ev"), F.explode(F.array(F.floor(F.col("event_id") / 500), F.floor(F.col("event_id") / 500) + 1)).alias("page"))
    pages = e.groupBy("session_id", "page").agg(_json(ccr=F.struct(F.collect_list("ev").alias("data"), L(False).alias("has_more"))).alias("j"))
    raw = F.when(F.col("page") % 2 == 0, F.col("j")).otherwise(F.to_json(F.array(F.struct(L("text").alias("type"), F.concat(L("Page: "), F.col("j"), L(" end")).alias("text")))))
    lines = event_pages.event_lines(pages.select("session_id", F.lpad(F.col("page").cast("string"), 9, "0").alias("page"), raw.alias("raw")))
    return al.calls(al.index_lines(al.parse_lines(lines))).select("session_id", "k", "context")


# ---------------------------------------------------------------- chats


MERGED = """t AS (SELECT conv_id, turn, role, text FROM conversations WHERE length(trim(text)) > 0 AND role IN ('user', 'assistant')),
k AS (SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn) <> role, true)::INT AS fresh FROM t),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM k),
m AS (SELECT conv_id, CAST(run - 1 AS BIGINT) AS idx, role, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM r GROUP BY conv_id, run, role),
mm AS (SELECT * FROM m WHERE conv_id IN (SELECT conv_id FROM m WHERE role = 'user'))"""


def _messages(spark, sf):
    """One row per conversation: its messages in order, as one export document holds them."""
    c = tables.load(spark, sf, "conversations")
    return c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("ms"))


def _export_documents(spark, sf):
    c = _messages(spark, sf)
    n = F.col("conv_id") % 5
    flat = F.transform("ms", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")))
    claude = F.transform("ms", lambda m: F.struct(F.when(m["role"] == "user", "human").otherwise(m["role"]).alias("sender"), m["text"].alias("text")))
    gemini = F.transform("ms", lambda m: F.struct(F.when(m["role"] == "assistant", "model").otherwise(m["role"]).alias("role"), F.array(F.struct(m["text"].alias("text"))).alias("parts")))
    node = lambda m: F.struct(F.struct(F.struct(m["role"].alias("role")).alias("author"), F.struct(F.array(m["text"]).alias("parts")).alias("content")).alias("message"),
                              F.when(m["turn"] > 0, F.concat(L("n"), (m["turn"] - 1).cast("string"))).alias("parent"))
    tree = F.map_from_entries(F.transform("ms", lambda m: F.struct(F.concat(L("n"), m["turn"].cast("string")).alias("key"), node(m).alias("value"))))
    current = F.concat(L("n"), F.element_at("ms", -1)["turn"].cast("string"))
    doc = F.when(n == 0, _json(messages=flat)).when(n == 1, _json(chat_messages=claude)).when(n == 2, _json(contents=gemini)) \
        .when(n == 3, _json(mapping=tree, current_node=current)).otherwise(_json(props=F.struct(F.struct(flat.alias("messages")).alias("page")), other=L(1)))
    return c.select(F.col("conv_id").alias("doc_id"), doc.alias("value"))


@query("export_turns", with_views(MERGED, "SELECT conv_id AS doc_id, CASE conv_id % 5 WHEN 1 THEN 'claude' WHEN 2 THEN 'gemini' WHEN 3 THEN 'chatgpt' ELSE 'openai-messages' END AS source, idx, role, md5(text) AS digest FROM mm"))
def export_turns(spark, sf):
    return chats.parse_documents(_export_documents(spark, sf)).select("doc_id", "source", "idx", "role", F.md5("text").alias("digest"))


@query("role_marked_turns", with_views(MERGED, "SELECT conv_id AS doc_id, idx, role, md5(regexp_replace(text, '\\s+', '', 'g')) AS digest FROM mm"))
def role_marked_turns(spark, sf):
    c = _messages(spark, sf)
    n = F.col("conv_id") % 3
    user = F.when(n == 0, "User: ").when(n == 1, "**User**: ").otherwise("## User\n")
    bot = F.when(n == 0, "Assistant: ").when(n == 1, "[Assistant]：").otherwise("## Assistant\n")
    spoken = F.filter("ms", lambda m: m["role"].isin("user", "assistant"))
    text = F.array_join(F.transform(spoken, lambda m: F.concat(F.when(m["role"] == "user", user).otherwise(bot), m["text"])), "\n\n")
    t = chats.role_marked(c.select(F.col("conv_id").alias("doc_id"), text.alias("text")))
    return t.select("doc_id", "idx", "role", F.md5(F.regexp_replace("text", r"\s+", "")).alias("digest"))


@query("share_page_turns", with_views(MERGED, """SELECT conv_id AS doc_id, idx, role, md5(regexp_replace(text, '\\s+', '', 'g')) AS digest FROM mm WHERE conv_id % 2 = 0
UNION ALL SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1, role, md5(regexp_replace(text, '\\s+', '', 'g')) FROM t WHERE conv_id % 2 = 1 AND conv_id IN (SELECT conv_id FROM t WHERE role = 'user')"""))
def share_page_turns(spark, sf):
    """Half the pages hold a JSON script block, half role-marked blocks with tags and entities."""
    c = _messages(spark, sf)
    flat = F.transform("ms", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")))
    script = F.concat(L('<html><script id="__NEXT_DATA__" type="application/json">'), _json(props=F.struct(flat.alias("messages"))), L("</script></html>"))
    spoken = F.filter("ms", lambda m: m["role"].isin("user", "assistant"))
    esc = lambda s: F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
    divs = F.concat(L("<main>"), F.array_join(F.transform(spoken, lambda m: F.concat(L('<div data-message-author-role="'), m["role"], L('" class="x"><p>'), esc(m["text"]), L("</p></div>"))), ""), L("</main>"))
    page = F.when(F.col("conv_id") % 2 == 0, script).otherwise(divs)
    t = chats.parse_pages(c.select(F.col("conv_id").alias("doc_id"), page.alias("html")))
    # a block runs to the next marker, so the opening of the next element stays at its end
    clean = F.regexp_replace(F.regexp_replace("text", r"<div\s*\z", ""), r"\s+", "")
    return t.select("doc_id", "idx", "role", F.md5(clean).alias("digest"))


@query("pages_without_chats", "SELECT CAST(count(*) AS BIGINT) AS turns FROM pages WHERE false")
def pages_without_chats(spark, sf):
    """Ordinary web pages hold no conversation."""
    p = tables.load(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), "html")
    return chats.parse_pages(p).agg(F.count(L(1)).alias("turns"))


# ---------------------------------------------------------------- usage reports


def _bodies(spark, sf):
    e = tables.load(spark, sf, "events")
    n = F.floor("value").cast("bigint")
    a = _json(usage=F.struct(n.alias("prompt_tokens"), (n + 1).alias("completion_tokens"), F.struct(L(3).alias("reasoning_tokens")).alias("completion_tokens_details")))
    b = _json(usage=F.struct(n.alias("input_tokens"), L(5).alias("cache_read_input_tokens"), L(7).alias("cache_creation_input_tokens"), (n + 2).alias("output_tokens")))
    openai = F.col("event_id") % 2 == 0
    return e.select("event_id", "user_id", F.when(openai, "openai").otherwise("anthropic").alias("provider"), F.when(F.col("event_id") % 9 == 0, L("{}")).when(openai, a).otherwise(b).alias("body"))


@query("usage_dialects", """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CAST(floor(value) AS BIGINT) ELSE CAST(floor(value) AS BIGINT) + 12 END AS input_tokens, CASE WHEN event_id % 2 = 0 THEN CAST(floor(value) AS BIGINT) + 1 ELSE CAST(floor(value) AS BIGINT) + 2 END AS output_tokens,
  CASE WHEN event_id % 2 = 0 THEN 3 ELSE 0 END::BIGINT AS reasoning_tokens, CASE WHEN event_id % 2 = 0 THEN 0 ELSE 5 END::BIGINT AS cached_input_tokens FROM events WHERE event_id % 9 <> 0""")
def usage_dialects(spark, sf):
    b = _bodies(spark, sf).select("event_id", ledger.usage(F.col("provider"), F.try_parse_json("body")).alias("u"))
    return b.where("u IS NOT NULL").select("event_id", "u.*")


def chunk_rows(spark, sf):
    """Each event as a streamed reply: start, two text deltas, usage (missing for every ninth), end."""
    e = tables.load(spark, sf, "events")
    n = F.floor("value").cast("bigint")
    openai = F.col("event_id") % 2 == 0
    d = lambda s: F.concat(L("data: "), s)
    text = lambda s: F.when(openai, d(_json(choices=F.array(F.struct(F.struct(s.alias("content")).alias("delta")))))).otherwise(d(_json(type=L("content_block_delta"), delta=F.struct(s.alias("text")))))
    known = F.col("event_id") % 9 != 0
    start = F.when(~openai & known, d(_json(type=L("message_start"), message=F.struct(F.struct(n.alias("input_tokens"), L(4).alias("cache_read_input_tokens")).alias("usage")))))
    end = F.when(openai & known, d(_json(usage=F.struct(n.alias("prompt_tokens"), (n + 1).alias("completion_tokens"))))).when(known, d(_json(type=L("message_delta"), usage=F.struct((n + 1).alias("output_tokens")))))
    done = F.when(openai, L("data: [DONE]")).otherwise(d(_json(type=L("message_stop"))))
    parts = F.array(start, text(F.col("event_type")), L(": keep-alive"), text(L(" and more words")), end, done)
    e = e.select(F.col("event_id").alias("request_id"), F.when(openai, "openai").otherwise("anthropic").alias("provider"), "ts", F.posexplode(parts).alias("seq", "data"))
    return e.where("data IS NOT NULL")


@query("metered_replies", """SELECT event_id AS request_id, CASE WHEN event_id % 9 = 0 THEN 100 WHEN event_id % 2 = 0 THEN CAST(floor(value) AS BIGINT) ELSE CAST(floor(value) AS BIGINT) + 4 END AS input_tokens,
  CASE WHEN event_id % 9 = 0 THEN CAST(ceil((length(event_type) + 15) / 4.0) AS BIGINT) ELSE CAST(floor(value) AS BIGINT) + 1 END AS output_tokens, event_id % 9 <> 0 AS measured FROM events""")
def metered_replies(spark, sf):
    reqs = tables.load(spark, sf, "events").select(F.col("event_id").alias("request_id"), L(100).cast("bigint").alias("input_estimate"))
    return ledger.metered(chunk_rows(spark, sf), reqs).select("request_id", "input_tokens", "output_tokens", "measured")


# ---------------------------------------------------------------- everything in one run


@query("bundle_tables", with_views(SIDE, """SELECT 'dataset' AS name, count(DISTINCT session_id)::BIGINT AS n_rows, sum(context)::BIGINT AS input, sum(is_instr)::BIGINT AS found FROM calls
UNION ALL SELECT 'floor', count(DISTINCT session_id)::BIGINT, sum(context)::BIGINT + (SELECT sum(context + 90007)::BIGINT FROM calls WHERE event_id % 7 = 0), (SELECT count(*) FROM (
  SELECT lag(result_hash) OVER w = result_hash AND lag(epoch) OVER w = epoch AS dup, is_error FROM tools WHERE has_result WINDOW w AS (PARTITION BY session_id, name, regexp_extract(input_sig, '([0-9]+)', 1) ORDER BY k)) WHERE dup OR is_error)::BIGINT FROM calls
UNION ALL SELECT 'bound', count(DISTINCT session_id)::BIGINT, sum(context)::BIGINT, count(*)::BIGINT FROM calls
UNION ALL SELECT 'whatif', 1::BIGINT, sum(context)::BIGINT, 0::BIGINT FROM calls"""))
def bundle_tables(spark, sf):
    """One run over transcripts with sub-agents; of the what-ifs only the measured input, on which all of them agree."""
    from ..operators import bundle

    out = f"{scale.shared_folder(spark)}/bundle-{uuid.uuid4().hex}"
    manifest = bundle.run(with_side_lines(spark, sf), out, "events")
    t = {name: spark.read.parquet(f"{out}/gold/{name}") for name in manifest["tables"]}
    size = lambda name: L(manifest["tables"][name]["rows"]).cast("bigint").alias("n_rows")
    total = lambda c: F.coalesce(F.sum(c), L(0)).cast("bigint")
    parts = [
        t["dataset"].agg(L("dataset").alias("name"), size("dataset"), total("input_processed").alias("input"), total("user_instructions").alias("found")),
        t["floor"].agg(L("floor").alias("name"), size("floor"), total("input_processed").alias("input"), total(F.col("w1_count") + F.col("w2_count")).alias("found")),
        t["bound"].agg(L("bound").alias("name"), size("bound"), total("measured_input").alias("input"), total("api_calls").alias("found")),
        t["whatif"].agg(L("whatif").alias("name"), F.count_distinct("measured").alias("n_rows"), F.max("measured").cast("bigint").alias("input"), L(0).cast("bigint").alias("found")),
    ]
    return functools.reduce(lambda a, b: a.unionByName(b), parts)
