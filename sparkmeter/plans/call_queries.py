"""Call-axis operators over the event histories read as agent sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, floor, labels, rules, survey, whatif
from ..sources import tables
from .registry import CALLS, query, with_views

EV = ["ts", "event_id"]


def c(sql: str) -> str:
    return with_views(CALLS, sql)


def _calls(spark, sf):
    return tables.calls(spark, sf)


def _uses(spark, sf):
    u = tables.tool_uses(spark, sf)
    return u.withColumns({"use_id": F.col("event_id"), "call_k": F.col("k"), "result_epoch": F.col("epoch"),
                          "result_instr": F.col("instr"), "result_at": F.col("k") + 1, "result_ctx_at": F.col("k") + 1})


# ---------------------------------------------------------------- normalisation


@query("calls_indexed", c("SELECT session_id, k, event_id, epoch, instr, context, CAST(cache_read AS BIGINT) AS cache_read, CAST(cache_write AS BIGINT) AS cache_write FROM calls"))
def calls_indexed(spark, sf):
    return tables.calls(spark, sf).select("session_id", "k", "event_id", "epoch", "instr", "context", "cache_read", "cache_write")


@query("instruction_starts", c("SELECT DISTINCT session_id, instr, k AS start_k FROM calls WHERE is_instr = 1"))
def instruction_starts(spark, sf):
    return starts(spark, sf).select("session_id", "instr", "start_k")


def starts(spark, sf):
    return tables.calls(spark, sf).where("is_instr = 1").select("session_id", "instr", F.col("k").alias("start_k"), "ts", "event_id")


@query("compaction_points", c("SELECT DISTINCT session_id, k AS at_call FROM calls WHERE is_compact = 1"))
def compaction_points(spark, sf):
    return tables.calls(spark, sf).where("is_compact = 1").select("session_id", F.col("k").alias("at_call")).distinct()


@query("tool_counts", c("""SELECT session_id, CASE WHEN name LIKE 'mcp\\_\\_%' ESCAPE '\\' THEN 'mcp' ELSE name END AS label, CAST(count(*) AS BIGINT) AS n,
  CAST(row_number() OVER (PARTITION BY session_id ORDER BY count(*) DESC, CASE WHEN name LIKE 'mcp\\_\\_%' ESCAPE '\\' THEN 'mcp' ELSE name END) AS INT) AS rank FROM tools GROUP BY 1, 2"""))
def tool_counts(spark, sf):
    return survey.tool_counts(tables.tool_uses(spark, sf))


# ---------------------------------------------------------------- audit


@query("session_totals", c("""SELECT session_id, CAST(count(*) AS BIGINT) AS api_calls, CAST(0 AS BIGINT) AS input, CAST(sum(cache_read) AS BIGINT) AS cache_read, CAST(sum(cache_write) AS BIGINT) AS cache_write,
  CAST(sum(output) AS BIGINT) AS output, CAST(sum(context) AS BIGINT) AS processed_input, max(context) AS peak_context, 100.0::DOUBLE * sum(cache_read) / sum(context) AS cache_hit_pct,
  sum(context)::DOUBLE / count(*) AS avg_context FROM calls GROUP BY session_id"""))
def session_totals(spark, sf):
    return audit.session_totals(tables.calls(spark, sf))


DUPS = """reads AS (SELECT *, CAST(coalesce(sum(CASE WHEN name = 'Write' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, path ORDER BY k), 0) AS BIGINT) AS writes FROM tools
  WHERE name = 'Write' OR (name = 'Read' AND has_result AND NOT is_error)),
dups0 AS (SELECT *, lag(writes) OVER w AS pw, lag(epoch) OVER w AS pe FROM reads WHERE name = 'Read' WINDOW w AS (PARTITION BY session_id, path ORDER BY k)),
dups AS (SELECT * FROM dups0 WHERE pw = writes AND pe = epoch),
fails0 AS (SELECT *, lag(is_error) OVER (PARTITION BY session_id, name, input_sig ORDER BY k) AS pf FROM tools WHERE has_result),
fails AS (SELECT * FROM fails0 WHERE is_error AND pf),
carry AS (SELECT t.*, t.result_tokens * greatest(0, e.epoch_end - t.k - 1) AS carried FROM tools t JOIN ends e USING (session_id, epoch))"""


@query("duplicate_reads", with_views(f"{CALLS},\n{DUPS}", "SELECT session_id, k, path FROM dups"))
def duplicate_reads(spark, sf):
    return audit.duplicate_reads(tables.tool_uses(spark, sf), EV).select("session_id", "k", "path")


def d(sql: str) -> str:
    return with_views(f"{CALLS},\n{DUPS}", sql)


@query("large_results", c("SELECT session_id, k, name, result_tokens FROM tools WHERE has_result AND result_tokens >= 2000"))
def large_results(spark, sf):
    return audit.large_results(tables.tool_uses(spark, sf)).select("session_id", "k", "name", "result_tokens")


@query("failed_repeats", d("SELECT session_id, k, name, input_sig FROM fails"))
def failed_repeats(spark, sf):
    return audit.failed_repeats(tables.tool_uses(spark, sf), EV).select("session_id", "k", "name", "input_sig")


@query("carried_results", d("SELECT session_id, k, result_tokens, CAST(carried AS BIGINT) AS carried_tokens FROM carry"))
def carried_results(spark, sf):
    return audit.with_carry(tables.tool_uses(spark, sf), tables.calls(spark, sf)).select("session_id", "k", "result_tokens", "carried_tokens")


@query("usage_by_tool", d("""SELECT session_id, name, CAST(count(*) AS BIGINT) AS calls, CAST(sum(result_tokens) AS BIGINT) AS result_tokens, CAST(sum(carried) AS BIGINT) AS carried_tokens,
  CAST(sum(is_error::INT) AS BIGINT) AS errors, CAST(sum(images) AS BIGINT) AS images FROM carry GROUP BY ALL"""))
def usage_by_tool(spark, sf):
    return audit.by_tool(audit.with_carry(tables.tool_uses(spark, sf), tables.calls(spark, sf)))


@query("tool_rollup", d("""SELECT name, CAST(CASE WHEN grouping(name) = 1 THEN 1 ELSE 0 END AS BIGINT) AS is_total, CAST(count(*) AS BIGINT) AS calls, CAST(sum(result_tokens) AS BIGINT) AS result_tokens,
  CAST(sum(carried) AS BIGINT) AS carried_tokens, CAST(sum(is_error::INT) AS BIGINT) AS errors, CAST(sum(images) AS BIGINT) AS images FROM carry GROUP BY GROUPING SETS ((name), ())"""))
def tool_rollup(spark, sf):
    return audit.tool_rollup(audit.by_tool(audit.with_carry(tables.tool_uses(spark, sf), tables.calls(spark, sf))))


AUDIT = f"""{DUPS},
big AS (SELECT * FROM tools WHERE has_result AND result_tokens >= 2000),
audits AS (SELECT session_id, count(*) AS api_calls, max(epoch) AS compactions, sum(cache_read) AS cache_read, sum(cache_write) AS cache_write, sum(output) AS output, sum(context) AS processed_input, max(context) AS peak_context FROM calls GROUP BY 1),
parts AS (SELECT session_id, count(*) AS tool_calls, sum(carried) AS carried_tokens,
  count(*) FILTER (WHERE (session_id, k) IN (SELECT (session_id, k) FROM dups)) AS dup_count, coalesce(sum(result_tokens) FILTER (WHERE (session_id, k) IN (SELECT (session_id, k) FROM dups)), 0) AS dup_tokens, coalesce(sum(carried) FILTER (WHERE (session_id, k) IN (SELECT (session_id, k) FROM dups)), 0) AS dup_carried,
  count(*) FILTER (WHERE (session_id, k) IN (SELECT (session_id, k) FROM big)) AS large_count, coalesce(sum(result_tokens) FILTER (WHERE (session_id, k) IN (SELECT (session_id, k) FROM big)), 0) AS large_tokens, coalesce(sum(carried) FILTER (WHERE (session_id, k) IN (SELECT (session_id, k) FROM big)), 0) AS large_carried,
  count(*) FILTER (WHERE (session_id, k) IN (SELECT (session_id, k) FROM fails)) AS failed_count, coalesce(sum(result_tokens) FILTER (WHERE (session_id, k) IN (SELECT (session_id, k) FROM fails)), 0) AS failed_tokens, coalesce(sum(carried) FILTER (WHERE (session_id, k) IN (SELECT (session_id, k) FROM fails)), 0) AS failed_carried
  FROM carry GROUP BY 1),
au AS (SELECT * FROM audits JOIN parts USING (session_id))"""
PART_COLS = [f"{p}_{m}" for p in audit.PARTS for m in ("count", "tokens", "carried")]


def _audit(spark, sf):
    return audit.audit(tables.calls(spark, sf), tables.tool_uses(spark, sf), EV)


@query("session_audit", with_views(f"{CALLS},\n{AUDIT}", "SELECT session_id, CAST(api_calls AS BIGINT) AS api_calls, CAST(tool_calls AS BIGINT) AS tool_calls, compactions, CAST(processed_input AS BIGINT) AS processed_input, peak_context, CAST(carried_tokens AS BIGINT) AS carried_tokens, " + ", ".join(f"CAST({x} AS BIGINT) AS {x}" for x in PART_COLS) + " FROM au"))
def session_audit(spark, sf):
    return _audit(spark, sf).select("session_id", "api_calls", "tool_calls", "compactions", "processed_input", "peak_context", "carried_tokens", *PART_COLS)


@query("audit_merged", with_views(f"{CALLS},\n{AUDIT}", "SELECT CAST(count(*) AS BIGINT) AS sessions, CAST(sum(api_calls) AS BIGINT) AS api_calls, max(peak_context) AS peak_context, 100.0::DOUBLE * sum(cache_read) / sum(processed_input) AS cache_hit_pct, 100.0::DOUBLE * sum(carried_tokens) / sum(processed_input) AS carried_share_pct, " + ", ".join(f"CAST(sum({x}) AS BIGINT) AS {x}" for x in PART_COLS) + " FROM au"))
def audit_merged(spark, sf):
    return audit.merge(_audit(spark, sf)).select("sessions", "api_calls", "peak_context", "cache_hit_pct", "carried_share_pct", *PART_COLS)


@query("audit_tips", with_views(f"{CALLS},\n{AUDIT}", """SELECT * FROM (SELECT session_id, 'dup_read' AS code, dup_carried::BIGINT AS weight, dup_count::BIGINT AS n, dup_tokens::BIGINT AS tokens FROM au
  UNION ALL SELECT session_id, 'large_output', large_carried::BIGINT, large_count::BIGINT, large_tokens::BIGINT FROM au UNION ALL SELECT session_id, 'failed_repeat', (failed_carried + failed_tokens)::BIGINT, failed_count::BIGINT, failed_tokens::BIGINT FROM au
  UNION ALL SELECT session_id, 'long_session', peak_context, CASE WHEN peak_context > 120000 THEN 1 ELSE 0 END::BIGINT, peak_context FROM au) WHERE n > 0"""))
def audit_tips(spark, sf):
    return audit.tips(_audit(spark, sf))


@query("subagent_calls_merged", c("SELECT CAST(count(DISTINCT session_id) FILTER (WHERE NOT is_side) AS BIGINT) AS sessions, CAST(count(*) FILTER (WHERE NOT is_side) AS BIGINT) AS api_calls, CAST(count(*) FILTER (WHERE is_side AND session_id IN (SELECT session_id FROM calls WHERE NOT is_side)) AS BIGINT) AS subagent_calls FROM calls"))
def subagent_calls_merged(spark, sf):
    """Sub-agents' calls in the export's totals; the tool uses are those of the main chain."""
    calls = tables.calls_with_sides(spark, sf)
    uses = tables.tool_uses(spark, sf).where("event_id % 7 <> 0")
    merged = audit.merge(audit.audit(calls, uses, EV))
    return audit.export(merged, audit.by_tool(audit.with_carry(uses, calls))).select("sessions", "api_calls", "subagent_calls")


@query("audit_export")
def audit_export(spark, sf):
    uses = audit.with_carry(tables.tool_uses(spark, sf), tables.calls(spark, sf))
    return audit.export(audit.merge(_audit(spark, sf)), audit.by_tool(uses))


@query("top_reread_paths", d("""SELECT * FROM (SELECT session_id, path, CAST(count(*) AS BIGINT) AS reads, CAST(row_number() OVER (PARTITION BY session_id ORDER BY count(*) DESC, path) AS INT) AS rank FROM dups GROUP BY 1, 2) WHERE rank <= 10"""))
def top_reread_paths(spark, sf):
    return audit.top_paths(audit.duplicate_reads(tables.tool_uses(spark, sf), EV))


@query("top_results", c("""SELECT * FROM (SELECT session_id, name, path, result_tokens, CAST(row_number() OVER (PARTITION BY session_id ORDER BY result_tokens DESC, name DESC, k) AS INT) AS rank FROM tools WHERE has_result AND result_tokens >= 2000) WHERE rank <= 10"""))
def top_results(spark, sf):
    return audit.top_results(audit.large_results(tables.tool_uses(spark, sf)), tie=EV)


# ---------------------------------------------------------------- floor

FLOOR = """j0 AS (SELECT *, lag(result_hash) OVER w AS ph, lag(epoch) OVER w AS pe FROM tools WHERE has_result WINDOW w AS (PARTITION BY session_id, name, input_sig ORDER BY k)),
judged AS (SELECT *, CASE WHEN ph = result_hash AND pe = epoch THEN 'W1' WHEN is_error THEN 'W2' END AS category FROM j0),
ch0 AS (SELECT *, least(cache_write, prev_ctx - cache_read) AS missed,
  CASE WHEN cache_write <> 0 THEN ((cache_write - cache_write_1h) * 1.25::DOUBLE + cache_write_1h * 2.0::DOUBLE) / cache_write ELSE 1.25 END AS rate FROM calls),
churn AS (SELECT *, missed * (rate - 0.1::DOUBLE) AS price_units, CASE WHEN prev_model <> model THEN 'model_switch' WHEN ts - prev_ts < INTERVAL '5' MINUTE THEN 'gap_under_5m'
  WHEN ts - prev_ts < INTERVAL '1' HOUR THEN 'gap_5m_to_1h' ELSE 'gap_over_1h' END AS cause FROM ch0 WHERE context >= prev_ctx AND missed > 0.02::DOUBLE * prev_ctx),
prices AS (SELECT session_id, count(*) AS calls, sum(context) AS input_processed, sum(cache_read) AS cache_read, sum(cache_write - cache_write_1h) AS w5, sum(cache_write_1h) AS w1h,
  (sum(cache_write - cache_write_1h) * 1.25::DOUBLE + sum(cache_write_1h) * 2.0::DOUBLE) / sum(cache_write) AS write_rate,
  sum(cache_read) * 0.1::DOUBLE + sum(cache_write - cache_write_1h) * 1.25::DOUBLE + sum(cache_write_1h) * 2.0::DOUBLE AS price_total FROM calls GROUP BY 1),
bad AS (SELECT session_id, coalesce(sum(result_tokens) FILTER (WHERE category = 'W1'), 0) AS w1_tokens, count(*) FILTER (WHERE category = 'W1') AS w1_count,
  coalesce(sum(result_tokens) FILTER (WHERE category = 'W2'), 0) AS w2_tokens, count(*) FILTER (WHERE category = 'W2') AS w2_count FROM judged GROUP BY 1),
w6 AS (SELECT session_id, sum(missed) AS w6_tokens, count(*) AS w6_count, sum(price_units) AS w6_price, coalesce(sum(price_units) FILTER (WHERE cause <> 'gap_over_1h'), 0) AS w6_short,
  coalesce(sum(price_units) FILTER (WHERE cause = 'gap_under_5m'), 0) AS w6_5m FROM churn GROUP BY 1),
floors AS (SELECT p.*, coalesce(w1_tokens, 0) AS w1_tokens, coalesce(w1_count, 0) AS w1_count, coalesce(w2_tokens, 0) AS w2_tokens, coalesce(w2_count, 0) AS w2_count, coalesce(w6_tokens, 0) AS w6_tokens,
  coalesce(w6_count, 0) AS w6_count, coalesce(w6_price, 0) AS w6_price, coalesce(w6_short, 0) AS w6_short, coalesce(w6_5m, 0) AS w6_5m FROM prices p LEFT JOIN bad USING (session_id) LEFT JOIN w6 USING (session_id))"""


def f(sql: str) -> str:
    return with_views(f"{CALLS},\n{FLOOR}", sql)


def _judged(spark, sf):
    return floor.judged_results(_uses(spark, sf), EV)


@query("duplicate_and_failed_results", f("SELECT session_id, k, name, category FROM judged WHERE category IS NOT NULL"))
def duplicate_and_failed_results(spark, sf):
    return _judged(spark, sf).where("category IS NOT NULL").select("session_id", "k", "name", "category")


@query("cache_churn", f("SELECT session_id, k, CAST(missed AS BIGINT) AS tokens, cause, round(price_units, 4) AS price_units FROM churn"))
def cache_churn(spark, sf):
    return floor.churn(_calls(spark, sf), EV).select("session_id", "k", "tokens", "cause", F.round("price_units", 4).alias("price_units"))


@query("cache_churn_causes", f("SELECT cause, CAST(count(*) AS BIGINT) AS n, CAST(sum(missed) AS BIGINT) AS tokens, round(sum(price_units), 2) AS price_units FROM churn GROUP BY 1"))
def cache_churn_causes(spark, sf):
    by = floor.churn_by_cause(floor.churn(_calls(spark, sf), EV))
    return by.groupBy("cause").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens"), F.round(F.sum("price_units"), 2).alias("price_units"))


@query("price_totals", f("SELECT session_id, CAST(calls AS BIGINT) AS calls, CAST(w5 AS BIGINT) AS cache_write_5m, CAST(w1h AS BIGINT) AS cache_write_1h, round(write_rate, 9) AS write_rate, round(price_total, 3) AS price_total_units FROM prices"))
def price_totals(spark, sf):
    return floor.price_totals(_calls(spark, sf)).select("session_id", "calls", "cache_write_5m", "cache_write_1h", F.round("write_rate", 9).alias("write_rate"), F.round("price_total_units", 3).alias("price_total_units"))


@query("carried_waste", f("""SELECT session_id, category, CAST(sum(result_tokens * greatest(0, coalesce(epoch_end, 0) - (k + 1))) AS BIGINT) AS carried FROM judged LEFT JOIN ends USING (session_id, epoch) WHERE category IS NOT NULL GROUP BY 1, 2"""))
def carried_waste(spark, sf):
    return floor.carried_waste(_judged(spark, sf), _calls(spark, sf))


@query("steps_on_waste", f("""SELECT t.session_id, t.k AS call_k, j.category, t.context AS input FROM tools t JOIN judged j USING (session_id, k) WHERE j.category IS NOT NULL AND NOT t.has_text"""))
def steps_on_waste(spark, sf):
    return floor.wasted_steps(_judged(spark, sf), _uses(spark, sf), _calls(spark, sf)).select("session_id", "call_k", "category", "input")


@query("steps_on_waste_by_tool", f("""SELECT j.category, CASE WHEN t.name = 'mcp__shop__buy' THEN 'mcp' ELSE t.name END AS name, CAST(count(*) AS BIGINT) AS calls, CAST(sum(t.context) AS BIGINT) AS input
  FROM tools t JOIN judged j USING (session_id, k) WHERE j.category IS NOT NULL AND NOT t.has_text GROUP BY 1, 2"""))
def steps_on_waste_by_tool(spark, sf):
    return floor.wasted_steps_by_tool(floor.wasted_steps(_judged(spark, sf), _uses(spark, sf), _calls(spark, sf)))


def _floor(spark, sf):
    calls = _calls(spark, sf)
    return floor.floor(calls, _judged(spark, sf), floor.churn(calls, EV))


@query("session_floor", f("""SELECT session_id, CAST(w1_count AS BIGINT) AS w1_count, CAST(w2_count AS BIGINT) AS w2_count, CAST(w6_count AS BIGINT) AS w6_count, CAST(w1_tokens + w2_tokens AS BIGINT) AS removable_tokens,
  round(100.0 * (w1_tokens + w2_tokens) / input_processed, 6) AS floor_pct_of_input, round(100.0 * ((w1_tokens + w2_tokens) * write_rate + w6_price) / price_total, 6) AS floor_pct_price_weighted FROM floors"""))
def session_floor(spark, sf):
    return _floor(spark, sf).select("session_id", "w1_count", "w2_count", "w6_count", "removable_tokens", F.round("floor_pct_of_input", 6).alias("floor_pct_of_input"), F.round("floor_pct_price_weighted", 6).alias("floor_pct_price_weighted"))


@query("corpus_floor", f("""SELECT CAST(count(*) AS BIGINT) AS sessions, CAST(sum(w1_tokens + w2_tokens) AS BIGINT) AS removable_tokens, round(100.0 * sum(w1_tokens + w2_tokens) / sum(input_processed), 6) AS floor_pct_of_input,
  round(100.0 * sum((w1_tokens + w2_tokens) * write_rate + w6_price) / sum(price_total), 6) AS floor_pct_price_weighted, round(100.0 * sum((w1_tokens + w2_tokens) * write_rate + w6_short) / sum(price_total), 6) AS pct_without_gap_over_1h,
  round(100.0 * sum((w1_tokens + w2_tokens) * write_rate + w6_5m) / sum(price_total), 6) AS pct_only_gap_under_5m FROM floors"""))
def corpus_floor(spark, sf):
    names = ["floor_pct_of_input", "floor_pct_price_weighted", "pct_without_gap_over_1h", "pct_only_gap_under_5m"]
    return floor.combine(_floor(spark, sf)).select("sessions", "removable_tokens", *[F.round(n, 6).alias(n) for n in names])


@query("instruction_flags", f("""SELECT DISTINCT session_id, instr, category FROM (SELECT session_id, instr, category FROM judged WHERE category IS NOT NULL UNION ALL SELECT session_id, instr, 'W6' FROM churn) WHERE instr >= 1"""))
def instruction_flags(spark, sf):
    return floor.instruction_flags(_judged(spark, sf), floor.churn(_calls(spark, sf), EV))


# ---------------------------------------------------------------- rules


@query("discarded_writes", c("""SELECT session_id, instr, CAST(sum(result_tokens) AS BIGINT) AS w4 FROM (SELECT *, lead(k) OVER (PARTITION BY session_id, path ORDER BY k) AS nk FROM tools WHERE name = 'Write')
  WHERE nk IS NOT NULL AND instr >= 1 AND result_tokens >= 1 GROUP BY 1, 2"""))
def discarded_writes(spark, sf):
    w = tables.tool_uses(spark, sf).where("name = 'Write'").withColumn("tokens", F.col("result_tokens"))
    return rules.discarded_output(w, EV)


# ---------------------------------------------------------------- survey


@query("session_measures", c("""SELECT c.session_id, CAST(count(*) AS BIGINT) AS api_calls, CAST(sum(context) AS BIGINT) AS input_processed, CAST(sum(cache_read) AS BIGINT) AS cache_read, CAST(sum(cache_write) AS BIGINT) AS cache_write,
  CAST(sum(c.output) AS BIGINT) AS output, arg_min(context, c.k) AS first_context, max(context) AS peak_context, max(c.epoch) AS compactions, (epoch_us(max(c.ts)) - epoch_us(min(c.ts))) / 3.6e9::DOUBLE AS span_hours,
  CAST(count(*) AS BIGINT) AS tool_calls, CAST(sum(t.is_error::INT) AS BIGINT) AS tool_errors, CAST(sum(images) AS BIGINT) AS images, CAST(sum(is_instr) AS BIGINT) AS user_instructions,
  100.0::DOUBLE * coalesce(sum(context) FILTER (WHERE context >= 200000), 0) / sum(context) AS ge_200k_pct, 100.0::DOUBLE * coalesce(sum(context) FILTER (WHERE context >= 400000), 0) / sum(context) AS ge_400k_pct,
  100.0::DOUBLE * coalesce(sum(context) FILTER (WHERE context >= 600000), 0) / sum(context) AS ge_600k_pct FROM calls c JOIN (SELECT session_id, k, is_error, images FROM tools) t USING (session_id, k) GROUP BY c.session_id"""))
def session_measures(spark, sf):
    return survey.measure(tables.calls(spark, sf), tables.tool_uses(spark, sf), starts(spark, sf))


@query("per_instruction_input", c("SELECT session_id, instr, CAST(count(*) AS BIGINT) AS calls, CAST(sum(context) AS BIGINT) AS input FROM calls WHERE instr >= 1 GROUP BY 1, 2"))
def per_instruction_input(spark, sf):
    return survey.per_instruction(tables.calls(spark, sf))


@query("active_hours", c("""SELECT session_id, coalesce(sum(CASE WHEN ts - prev_ts <= INTERVAL '30' MINUTE THEN epoch_us(ts) - epoch_us(prev_ts) END), 0)::DOUBLE / 3.6e9::DOUBLE AS active_hours FROM calls GROUP BY 1"""))
def active_hours(spark, sf):
    return survey.active_hours(tables.calls(spark, sf), EV)


@query("context_curve", c("""SELECT session_id, CAST(p AS INT) AS point, k, context FROM (SELECT session_id, unnest(range(0, 40)) AS p, n FROM (SELECT session_id, max(k) + 1 AS n FROM calls GROUP BY 1))
  JOIN calls USING (session_id) WHERE k = least(n - 1, CAST(round_even(p * (n - 1) / 39.0::DOUBLE, 0) AS BIGINT))"""))
def context_curve(spark, sf):
    return survey.context_curve(tables.calls(spark, sf))


@query("context_quartiles", c("""SELECT session_id, quantile_cont(context, 0.25)::DOUBLE AS q1, quantile_cont(context, 0.5)::DOUBLE AS median, quantile_cont(context, 0.75)::DOUBLE AS q3 FROM calls GROUP BY 1"""))
def context_quartiles(spark, sf):
    return survey.quantiles(tables.calls(spark, sf), ["session_id"], "context", q1=0.25, median=0.5, q3=0.75)


@query("instruction_input_quartiles", c("""SELECT round(quantile_cont(i, 0.25), 4)::DOUBLE AS q1, round(quantile_cont(i, 0.5), 4)::DOUBLE AS median, round(quantile_cont(i, 0.75), 4)::DOUBLE AS q3
  FROM (SELECT sum(context)::DOUBLE AS i FROM calls WHERE instr >= 1 GROUP BY session_id, instr)"""))
def instruction_input_quartiles(spark, sf):
    q = survey.quantiles(survey.per_instruction(tables.calls(spark, sf)), [], "input", q1=0.25, median=0.5, q3=0.75)
    return q.select(*[F.round(n, 4).alias(n) for n in ("q1", "median", "q3")])


@query("subagent_rollup", c("SELECT session_id, is_side, CAST(count(*) AS BIGINT) AS api_calls, CAST(sum(context) AS BIGINT) AS input_processed, CAST(sum(cache_read) AS BIGINT) AS cache_read, CAST(sum(cache_write) AS BIGINT) AS cache_write, CAST(sum(output) AS BIGINT) AS output FROM calls GROUP BY 1, 2"))
def subagent_rollup(spark, sf):
    return survey.subagent_rollup(tables.calls_with_sides(spark, sf))


DEC = """dec0 AS (SELECT *, first_value(context) OVER (PARTITION BY session_id ORDER BY k) AS base, first_value(context) OVER (PARTITION BY session_id, instr ORDER BY k) AS start FROM calls),
dec AS (SELECT *, least(context, base) AS fixed, greatest(0, least(context, start) - base) AS carried FROM dec0)"""


@query("context_decomposition", with_views(f"{CALLS},\n{DEC}", "SELECT session_id, CAST(sum(fixed) AS BIGINT) AS fixed, CAST(sum(carried) AS BIGINT) AS carried, CAST(sum(context - fixed - carried) AS BIGINT) AS current FROM dec GROUP BY 1"))
def context_decomposition(spark, sf):
    return survey.decompose(tables.calls(spark, sf), order=EV)


INSTR = "ins AS (SELECT session_id, instr, count(*) AS calls, sum(context)::BIGINT AS input FROM calls WHERE instr >= 1 GROUP BY 1, 2)"


@query("input_concentration", with_views(f"{CALLS},\n{INSTR}", """SELECT fraction, sum(input)::DOUBLE / max(t) AS share FROM (SELECT input, row_number() OVER (ORDER BY input DESC) AS rn, count(*) OVER () AS n, sum(input) OVER () AS t FROM ins), (SELECT unnest([0.01, 0.05, 0.1, 0.2, 0.5])::DOUBLE AS fraction)
  WHERE rn <= greatest(1, round_even(fraction * n, 0)) GROUP BY fraction"""))
def input_concentration(spark, sf):
    return survey.concentration(survey.per_instruction(tables.calls(spark, sf)))


@query("cumulative_input", with_views(f"{CALLS},\n{INSTR}", """SELECT input, CAST(n AS BIGINT) AS n, sum(input * n) OVER (ORDER BY input DESC)::DOUBLE / sum(input * n) OVER () AS cum_share FROM (SELECT input, count(*) AS n FROM ins GROUP BY 1)"""))
def cumulative_input(spark, sf):
    return survey.cumulative_shares(survey.per_instruction(tables.calls(spark, sf)))


@query("corpus_summary", with_views(f"{CALLS},\n{DEC}", """SELECT CAST(count(DISTINCT session_id) AS BIGINT) AS sessions, CAST(sum(context) AS BIGINT) AS total_input, CAST(sum(is_instr) AS BIGINT) AS instructions, CAST(count(*) AS BIGINT) AS calls, sum(context)::DOUBLE / sum(is_instr) AS per_instruction_mean,
  CAST(sum(fixed) AS BIGINT) AS fixed, CAST(sum(carried) AS BIGINT) AS carried, (SELECT min(r) FROM (SELECT sum(output)::DOUBLE / sum(context) AS r FROM calls GROUP BY session_id)) AS output_ratio_low FROM dec"""))
def corpus_summary(spark, sf):
    calls = tables.calls(spark, sf)
    m = survey.measure(calls, tables.tool_uses(spark, sf), starts(spark, sf))
    return survey.derive(m, survey.decompose(calls, order=EV)).select("sessions", "total_input", "instructions", "calls", "per_instruction_mean", "fixed", "carried", "output_ratio_low")


@query("largest_sessions", c("""SELECT session_id, input_processed, input_processed::DOUBLE / (SELECT sum(context) FROM calls) AS share FROM (SELECT session_id, sum(context)::BIGINT AS input_processed FROM calls GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)"""))
def largest_sessions(spark, sf):
    m = tables.calls(spark, sf).groupBy("session_id").agg(F.sum("context").alias("input_processed"))
    return survey.ranked_sessions(m)


@query("context_growth", c("SELECT session_id, CAST(sum(CASE WHEN context > prev_ctx THEN context - prev_ctx ELSE 0 END) AS BIGINT) AS growth_sum, CAST(count(*) AS BIGINT) AS growth_steps FROM calls GROUP BY 1"))
def context_growth(spark, sf):
    return survey.growth(tables.calls(spark, sf), EV)


@query("ceiling_model", c("""SELECT g AS growth_per_call, 64000.0::DOUBLE AS post_compaction, round(64000 + sqrt(2 * g * 64000), 6) AS optimum FROM (SELECT sum(CASE WHEN context > prev_ctx THEN context - prev_ctx ELSE 0 END)::DOUBLE / count(*) AS g FROM calls)"""))
def ceiling_model(spark, sf):
    return survey.ceiling_model(survey.growth(tables.calls(spark, sf), EV)).withColumn("optimum", F.round("optimum", 6))


@query("post_compaction_size", c("""SELECT session_id, coalesce(CAST(floor(quantile_cont(context, 0.5) FILTER (WHERE context < prev_ctx / 2.0)) AS BIGINT), 64000) AS post FROM calls GROUP BY 1"""))
def post_compaction_size(spark, sf):
    return survey.observed_post(tables.calls(spark, sf), EV)


#: The main chains of calls of which every seventh event's is a sub-agent's, by side.
SIDES = """sided AS (SELECT *, CASE WHEN session_id % 2 = 0 THEN 'before' ELSE 'after' END AS side FROM calls),
mc AS (SELECT * REPLACE (row_number() OVER (PARTITION BY session_id ORDER BY k) - 1 AS k) FROM sided WHERE NOT is_side),
dec0 AS (SELECT *, first_value(context) OVER (PARTITION BY session_id ORDER BY k) AS base, first_value(context) OVER (PARTITION BY session_id, instr ORDER BY k) AS start FROM mc),
dec AS (SELECT *, greatest(0, least(context, start) - base) AS carried FROM dec0),
ins AS (SELECT side, session_id, instr, count(*) AS calls, sum(context)::BIGINT AS input FROM mc WHERE instr >= 1 GROUP BY ALL),
per AS (SELECT side, session_id, count(*) AS calls, max(epoch) AS comps, (SELECT count(*) FROM ins i WHERE i.session_id = mc.session_id) AS n_instr,
  (SELECT count(*) FROM sided b WHERE b.session_id = mc.session_id AND b.is_side) AS sub_calls FROM mc GROUP BY side, session_id)"""


def _sided(spark, sf):
    return tables.calls_with_sides(spark, sf).withColumn("side", _side())


def _side():
    return F.when(F.col("session_id") % 2 == 0, "before").otherwise("after")


@query("before_after_summary", with_views(f"{CALLS},\n{SIDES}", """SELECT p.side, CAST(count(*) AS BIGINT) AS sessions, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(sub_calls) AS BIGINT) AS subagent_calls, CAST(sum(n_instr) AS BIGINT) AS instructions,
  1000::DOUBLE * sum(comps) / sum(calls) AS compactions_per_1000_calls, sum(n_instr)::DOUBLE / count(*) AS instructions_per_session, quantile_cont(n_instr, 0.5)::DOUBLE AS instructions_per_session_median,
  (SELECT sum(carried)::DOUBLE / sum(context) FROM dec WHERE dec.side = p.side) AS carried_share,
  (SELECT quantile_cont(input, 0.5)::DOUBLE FROM ins WHERE ins.side = p.side) AS median_input_per_instruction, (SELECT quantile_cont(calls, 0.5)::DOUBLE FROM ins WHERE ins.side = p.side) AS median_steps_per_instruction,
  (SELECT quantile_cont(context, 0.5)::DOUBLE FROM mc WHERE mc.side = p.side) AS median_context_per_call,
  count(*) < 5 OR sum(n_instr) < 30 AS too_small FROM per p GROUP BY p.side"""))
def before_after_summary(spark, sf):
    return survey.summarize_sides(_sided(spark, sf), order=EV)


@query("before_after_ratios", with_views(f"{CALLS},\n{SIDES}", """SELECT measure, max(v) FILTER (WHERE side = 'before') AS before, max(v) FILTER (WHERE side = 'after') AS "after", max(v) FILTER (WHERE side = 'after') / max(v) FILTER (WHERE side = 'before') AS ratio FROM (
  SELECT side, 'median_input_per_instruction' AS measure, quantile_cont(input, 0.5)::DOUBLE AS v FROM ins GROUP BY 1 UNION ALL
  SELECT side, 'carried_share', sum(carried)::DOUBLE / sum(context) FROM dec GROUP BY 1) GROUP BY 1"""))
def before_after_ratios(spark, sf):
    return survey.ratios(survey.summarize_sides(_sided(spark, sf), order=EV), ["median_input_per_instruction", "carried_share"])


@query("before_after_models", with_views(f"{CALLS},\n{SIDES}", """SELECT side, model, count(*) AS sessions FROM (
  SELECT side, session_id, model, row_number() OVER (PARTITION BY session_id ORDER BY count(*) DESC, min(k)) AS rn FROM mc GROUP BY side, session_id, model) WHERE rn = 1 GROUP BY ALL"""))
def before_after_models(spark, sf):
    return survey.side_models(_sided(spark, sf))


@query("before_after_floor", f("""SELECT CASE WHEN session_id % 2 = 0 THEN 'before' ELSE 'after' END AS side, round(100.0 * sum((w1_tokens + w2_tokens) * write_rate + w6_price) / sum(price_total), 6) AS removable_cost_pct,
  round(100.0 * sum(w1_tokens + w2_tokens) / sum(input_processed), 6) AS removable_tokens_pct, round(1000.0 * sum(w1_count) / (SELECT count(*) FROM calls c WHERE c.session_id % 2 = any_value(floors.session_id) % 2), 6) AS w1_per_1000_calls FROM floors GROUP BY 1"""))
def before_after_floor(spark, sf):
    """Removable cost and duplicates of both sides, over calls that are all of the main chain."""
    s = survey.summarize_sides(tables.calls(spark, sf).withColumn("side", _side()), _floor(spark, sf).withColumn("side", _side()), EV)
    return s.select("side", *[F.round(c, 6).alias(c) for c in ("removable_cost_pct", "removable_tokens_pct", "w1_per_1000_calls")])


@query("before_after_interval")
def before_after_interval(spark, sf):
    from ..operators.policy import bootstrap_ratio

    return bootstrap_ratio(survey.per_instruction(_sided(spark, sf)).withColumn("side", _side()), reps=200)


# ---------------------------------------------------------------- what-if

CAP_SQL = """, cap AS (SELECT session_id, k, context AS x, 0::BIGINT AS prev, context AS s, context AS total, 0::BIGINT AS comps, base FROM
    (SELECT *, first_value(context) OVER (PARTITION BY session_id ORDER BY k) AS base FROM calls) WHERE k = 0
  UNION ALL SELECT c.session_id, c.k, c.context, p.x, CASE WHEN full_ THEN landed ELSE cont END, p.total + CASE WHEN full_ THEN cont + landed ELSE cont END, p.comps + full_::INT, p.base
  FROM cap p JOIN calls c ON c.session_id = p.session_id AND c.k = p.k + 1,
  LATERAL (SELECT c.context - p.x AS dd) l1, LATERAL (SELECT CASE WHEN dd >= 0 THEN p.s + dd WHEN p.s >= 0.9::DOUBLE * p.x THEN least(p.s, c.context) ELSE p.s END AS cont, p.base + 10000 + least(dd, 100000) AS landed) l2,
  LATERAL (SELECT dd >= 0 AND cont > 100000 AND landed < cont AS full_) l3)"""


@query("capped_context", "WITH RECURSIVE " + CALLS + CAP_SQL + """
SELECT session_id, CAST(max(total) AS BIGINT) AS input, CAST(max(comps) AS BIGINT) AS compactions FROM cap GROUP BY 1""")
def capped_context(spark, sf):
    """One ceiling, landing on base + summary."""
    sc = whatif.Scenario("cap", ceiling=100_000, capped=True)
    return whatif.replay(whatif.series(tables.calls(spark, sf), order=EV), [sc]).select("session_id", "input", "compactions")


TASK_SQL = """, marks AS (SELECT *, first_value(context) OVER (PARTITION BY session_id ORDER BY k) AS base, max(context) OVER (PARTITION BY session_id) AS ceiling,
    coalesce(lag(instr) OVER (PARTITION BY session_id ORDER BY k) <> instr, true) AS opens FROM calls),
  posts AS (SELECT session_id, coalesce(CAST(floor(quantile_cont(context, 0.5) FILTER (WHERE context < prev_ctx / 2.0)) AS BIGINT), 64000) AS post FROM calls GROUP BY 1),
  run AS (SELECT session_id, k, context AS x, context AS s, context AS total, 0::BIGINT AS restarts FROM marks WHERE k = 0
  UNION ALL SELECT c.session_id, c.k, c.context, CASE WHEN go THEN fresh WHEN full_ THEN landed ELSE cont END, p.total + CASE WHEN go THEN fresh WHEN full_ THEN cont + landed ELSE cont END, p.restarts + go::INT
  FROM run p JOIN marks c ON c.session_id = p.session_id AND c.k = p.k + 1 JOIN posts q ON q.session_id = c.session_id,
  LATERAL (SELECT c.context - p.x AS dd) l1, LATERAL (SELECT CASE WHEN dd >= 0 THEN p.s + dd WHEN p.s >= 0.9::DOUBLE * p.x THEN least(p.s, c.context) ELSE p.s END AS cont, c.base + 2000 + greatest(0, dd) AS fresh, q.post + least(dd, c.ceiling) AS landed) l2,
  LATERAL (SELECT c.opens AND fresh < cont AS go, dd >= 0 AND cont > c.ceiling AND landed < cont AS full_) l3)"""


@query("task_scoped_context", "WITH RECURSIVE " + CALLS + TASK_SQL + """
SELECT session_id, CAST(max(total) AS BIGINT) AS input, CAST(max(restarts) AS BIGINT) AS restarts FROM run GROUP BY 1""")
def task_scoped_context(spark, sf):
    """Every instruction starts from base + summary."""
    return whatif.replay(whatif.series(tables.calls(spark, sf), order=EV), [whatif.task_scoped(2_000)]).select("session_id", "input", "restarts")


@query("whatif_sweep")
def whatif_sweep(spark, sf):
    return whatif.sweep(tables.calls(spark, sf), order=EV)


# ---------------------------------------------------------------- labelling frame


@query("labelling_frame", with_views(f"{CALLS},\n{INSTR}", """SELECT session_id, instr, CAST(idx AS BIGINT) AS idx, session_id::VARCHAR || '|' || CASE WHEN input < t1 THEN 's' WHEN input < t2 THEN 'm' ELSE 'l' END AS stratum FROM
  (SELECT session_id, instr, input, row_number() OVER (PARTITION BY session_id ORDER BY instr) - 1 AS idx FROM ins) JOIN
  (SELECT session_id, list_sort(list(input))[len(list(input)) // 3 + 1] AS t1, list_sort(list(input))[(2 * len(list(input))) // 3 + 1] AS t2 FROM ins GROUP BY 1) USING (session_id)"""))
def labelling_frame(spark, sf):
    items = survey.per_instruction(tables.calls(spark, sf))
    return labels.sampling_frame(items).select("session_id", "instr", "idx", "stratum")


@query("labelling_packet")
def labelling_packet(spark, sf):
    return labels.packet(survey.per_instruction(tables.calls(spark, sf))).select("item_id", "part", "session_id", "idx", "instr", "stratum")


@query("machine_labels", with_views(f"{CALLS},\n{FLOOR},\n{INSTR}", """SELECT session_id, instr, category, CASE WHEN EXISTS (SELECT 1 FROM (SELECT session_id, instr, category FROM judged UNION ALL SELECT session_id, instr, 'W6' FROM churn) g
  WHERE g.session_id = i.session_id AND g.instr = i.instr AND g.category = x.category) THEN 'yes' ELSE 'no' END AS choice FROM ins i, (SELECT unnest(['W1', 'W2', 'W6']) AS category) x"""))
def machine_labels(spark, sf):
    """Every instruction as an item, labelled by the mechanical judge."""
    items = survey.per_instruction(tables.calls(spark, sf)).withColumn("item_id", F.concat_ws("|", "session_id", "instr"))
    flags = floor.instruction_flags(_judged(spark, sf), floor.churn(_calls(spark, sf), EV))
    out = labels.machine_labels(items, flags)
    ids = items.select("item_id", "session_id", "instr")
    return out.join(ids, "item_id").select("session_id", "instr", "category", "choice")
