"""Step anatomy, resident duplicates and sensitivity of results to sessions, position and chance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import residency, sensitivity, steps, survey
from ..sources import tables
from .registry import CALLS, query, with_views


def on_calls(views: str, body: str) -> str:
    return with_views(f"{CALLS},\n{views}", body)


# ---------------------------------------------------------------- steps

#: The events have no shell commands: purchases wait, every fourth click is a commit, errors are test runs.
COMMANDS = {"error": "python -m pytest -q 'git push'", "purchase": "sleep 30", "click": "git commit -m 'cat > x'"}

STEPS = """steps AS (SELECT session_id, instr, k, context, result_hash,
  CASE WHEN event_type = 'signup' OR event_type = 'view' THEN 'read' WHEN event_type = 'purchase' THEN 'poll' WHEN event_type = 'error' THEN 'verify'
    WHEN event_id % 4 = 0 THEN 'vcs' ELSE 'edit' END AS cls, is_error AND event_type = 'error' AND event_id % 17 <> 0 AS failed FROM calls)"""


def st(sql: str) -> str:
    return on_calls(STEPS, sql)


def _steps(spark, sf):
    calls = tables.calls(spark, sf)
    command = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in COMMANDS.items()])
    shell = F.col("event_type").isin("error", "purchase") | ((F.col("event_type") == "click") & (F.col("event_id") % 4 == 0))
    uses = tables.tool_uses(spark, sf).withColumns({"call_k": F.col("k"), "command": command, "name": F.when(shell, "Bash").otherwise(F.col("name"))})
    return steps.classify(calls.drop("is_error", "name", "result_hash"), uses)


@query("step_classes", st("SELECT session_id, cls, count(*) AS steps, count(*) FILTER (WHERE failed) AS failed, CAST(sum(context) AS BIGINT) AS input FROM steps GROUP BY ALL"))
def step_classes(spark, sf):
    return _steps(spark, sf).groupBy("session_id", "cls").agg(
        F.count(F.lit(1)).alias("steps"), F.sum(F.col("failed").cast("bigint")).alias("failed"), F.sum("context").alias("input"))


@query("edit_verify_loops", st("""SELECT * EXCLUDE (fresh), CAST(sum(fresh) OVER (PARTITION BY session_id, instr ORDER BY end_k) AS BIGINT) AS chain FROM (
  SELECT session_id, instr, start_k, failed_k, end_k, failures, failed_n - start_n + 1 AS steps, input, CASE WHEN lag(end_k) OVER (PARTITION BY session_id, instr ORDER BY end_k) = start_k THEN 0 ELSE 1 END AS fresh FROM (
    SELECT session_id, instr, ks[p - n - 1] AS start_k, ks[p - 1] AS failed_k, ks[p] AS end_k, n AS failures, ns[p - n - 1] AS start_n, ns[p - 1] AS failed_n, CAST(ins[p - 1] - ins[p - n - 1] + cs[p - n - 1] AS BIGINT) AS input FROM (
      SELECT *, length(regexp_extract(substr(word, 1, p), 'EF+E$')) - 2 AS n FROM (
        SELECT *, CAST(unnest(range(1, length(word) + 1)) AS BIGINT) AS p FROM (
          SELECT session_id, instr, string_agg(sym, '' ORDER BY k) AS word, list(k ORDER BY k) AS ks, list(rn ORDER BY k) AS ns, list(run ORDER BY k) AS ins, list(context ORDER BY k) AS cs FROM (
            SELECT *, CASE cls WHEN 'edit' THEN 'E' WHEN 'verify' THEN CASE WHEN failed THEN 'F' ELSE 'P' END END AS sym, row_number() OVER w AS rn, sum(context) OVER w AS run
            FROM steps WINDOW w AS (PARTITION BY session_id, instr ORDER BY k)) WHERE sym IS NOT NULL GROUP BY ALL))) WHERE n > 0))"""))
def edit_verify_loops(spark, sf):
    return steps.loops(_steps(spark, sf))


@query("polling_runs", st("""SELECT session_id, instr, min(k) AS start_k, count(*) AS steps, CAST(sum(context) AS BIGINT) AS input, CAST(sum(same) AS BIGINT) AS identical, sum(context)::DOUBLE * (count(*) - 1) / count(*) AS saved FROM (
  SELECT *, row_number() OVER (PARTITION BY session_id, instr ORDER BY k) - row_number() OVER (PARTITION BY session_id, instr, cls ORDER BY k) AS island,
    CASE WHEN lag(cls) OVER w = 'poll' AND lag(result_hash) OVER w = result_hash THEN 1 ELSE 0 END AS same FROM steps WINDOW w AS (PARTITION BY session_id, instr ORDER BY k))
  WHERE cls = 'poll' GROUP BY session_id, instr, island HAVING count(*) >= 2"""))
def polling_runs(spark, sf):
    return steps.polling_runs(_steps(spark, sf))


# ---------------------------------------------------------------- residency

LINES = r"""d AS (SELECT coalesce(source, '') AS session_id, doc_id // 100 AS epoch, doc_id AS ord, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '<system-reminder>.*?</system-reminder>', '', 'gs'), chr(10)),
  lambda x: trim(regexp_replace(regexp_replace(x, '^ *[0-9]+(→|\t)', ''), '[ \t\r\f\x0B]+', ' ', 'g'))), lambda x: length(x) >= 12) AS ls FROM documents),
l AS (SELECT * EXCLUDE (ls), len(ls) AS n, unnest(ls) AS line, unnest(range(0, len(ls))) AS pos FROM d),
u AS (SELECT session_id, epoch, ord, n, 1 AS width, pos, line AS h FROM l
  UNION ALL SELECT session_id, epoch, ord, n, 3, pos, h FROM (SELECT *, line || chr(10) || lead(line) OVER w || chr(10) || lead(line, 2) OVER w AS h FROM l WINDOW w AS (PARTITION BY session_id, epoch, ord ORDER BY pos)) WHERE h IS NOT NULL),
f AS (SELECT session_id, epoch, width, h, min(ord) AS first FROM u GROUP BY ALL),
held AS (SELECT DISTINCT session_id, epoch, ord, p + i AS pos FROM (SELECT u.session_id, u.epoch, u.ord, u.pos AS p, unnest(range(0, u.width)) AS i FROM u JOIN f USING (session_id, epoch, width, h)
  WHERE u.ord > f.first AND u.width = CASE WHEN u.n >= 3 THEN 3 ELSE 1 END)),
sums AS (SELECT session_id, epoch, ord, count(h.pos) AS held_lines, CAST(coalesce(sum(length(line)) FILTER (WHERE h.pos IS NOT NULL), 0) AS BIGINT) AS held_chars, CAST(sum(length(line)) AS BIGINT) AS chars FROM l LEFT JOIN held h USING (session_id, epoch, ord, pos) GROUP BY ALL)"""


@query("resident_duplicates", with_views(LINES, """SELECT d.session_id, d.epoch, d.ord, CAST(len(ls) AS BIGINT) AS n_lines, coalesce(chars, 0) AS chars, coalesce(held_lines, 0) AS held_lines, coalesce(held_chars, 0) AS held_chars,
  CASE WHEN held_chars >= 0.95 * chars THEN 'full' WHEN held_chars >= 0.5 * chars THEN 'mostly' ELSE 'low' END AS class FROM d LEFT JOIN sums USING (session_id, epoch, ord)"""))
def resident_duplicates(spark, sf):
    """A source's documents read as the results of one session, compacted at every hundredth id."""
    docs = tables.load(spark, sf, "documents")
    return residency.resident_duplicates(docs.select(
        F.coalesce("source", F.lit("")).alias("session_id"), F.expr("doc_id div 100").alias("epoch"), F.col("doc_id").alias("ord"), "text"))


# ---------------------------------------------------------------- sensitivity


def _shares(spark, sf):
    """Each session's cached and whole input, and its share in percent."""
    per = tables.calls(spark, sf).groupBy("model", "session_id").agg(F.sum("cache_read").alias("part"), F.sum("context").alias("whole"))
    return per.withColumn("share", F.round(100 * F.col("part") / F.col("whole"), 1))


SHARES = "shares AS (SELECT model, session_id, CAST(sum(cache_read) AS BIGINT) AS part, CAST(sum(context) AS BIGINT) AS whole, round(100 * sum(cache_read)::DOUBLE / sum(context), 1) AS share FROM calls GROUP BY 1, 2)"


def sh(sql: str) -> str:
    return on_calls(SHARES, sql)


@query("medians_without_session", sh("""SELECT a.model, a.session_id, a.share, (SELECT median(b.share) FROM shares b WHERE b.model = a.model AND b.session_id <> a.session_id) AS without FROM shares a"""))
def medians_without_session(spark, sf):
    return sensitivity.median_without(_shares(spark, sf), ["model"], "share").select("model", "session_id", "share", "without")


@query("ratios_without_session", sh("""SELECT a.model, a.session_id, part, whole, p / w AS pooled, (p - part) / nullif(w - whole, 0) AS without
  FROM shares a JOIN (SELECT model, sum(part)::DOUBLE AS p, sum(whole)::DOUBLE AS w FROM shares GROUP BY 1) USING (model)"""))
def ratios_without_session(spark, sf):
    return sensitivity.ratio_without(_shares(spark, sf), ["model"], "session_id", "part", "whole")


@query("driving_sessions", sh("""SELECT model, max(pooled) AS pooled, min(without) AS least, max(without) AS most, first(session_id ORDER BY abs(without - pooled) DESC, session_id) AS driver FROM (
  SELECT a.model, a.session_id, p / w AS pooled, (p - part) / nullif(w - whole, 0) AS without FROM shares a JOIN (SELECT model, sum(part)::DOUBLE AS p, sum(whole)::DOUBLE AS w FROM shares GROUP BY 1) USING (model))
  WHERE without IS NOT NULL GROUP BY 1"""))
def driving_sessions(spark, sf):
    return sensitivity.drivers(sensitivity.ratio_without(_shares(spark, sf), ["model"], "session_id", "part", "whole"), ["model"], "session_id")


POSITION = """items AS (SELECT session_id, instr, count(*) AS calls, CAST(sum(context) AS BIGINT) AS input FROM calls WHERE instr >= 1 GROUP BY 1, 2),
long AS (SELECT session_id, instr, 'calls' AS measure, calls AS y FROM items UNION ALL SELECT session_id, instr, 'input', input FROM items)"""
RHO = """SELECT {by} measure, count(*) AS n, CASE WHEN min(y) < max(y) AND min(instr) < max(instr) THEN corr(rx, ry) END AS rho FROM (
  SELECT *, rank() OVER (PARTITION BY {by} measure ORDER BY instr) + (count(*) OVER (PARTITION BY {by} measure, instr) - 1) / 2.0 AS rx,
    rank() OVER (PARTITION BY {by} measure ORDER BY y) + (count(*) OVER (PARTITION BY {by} measure, y) - 1) / 2.0 AS ry FROM long) GROUP BY ALL"""


def rho(by: str) -> str:
    return on_calls(POSITION, RHO.format(by=by))


@query("position_correlation", rho(""))
def position_correlation(spark, sf):
    return sensitivity.rank_correlations(survey.per_instruction(tables.calls(spark, sf)), [], "instr", calls="calls", input="input")


@query("position_correlation_by_session", rho("session_id, "))
def position_correlation_by_session(spark, sf):
    return sensitivity.rank_correlations(survey.per_instruction(tables.calls(spark, sf)), ["session_id"], "instr", calls="calls", input="input")


PLACEBOS = """points AS (SELECT session_id, k AS at_k FROM calls WHERE is_compact = 1),
sizes AS (SELECT session_id, count(*) AS n FROM calls GROUP BY 1),
drawn AS (SELECT session_id, d, CASE WHEN d = 0 THEN at_k ELSE ('0x' || substr(md5('1:' || session_id || ':' || at_k || ':' || d), 1, 12))::BIGINT % n END AS a FROM points JOIN sizes USING (session_id), (SELECT unnest(range(0, 21)) AS d)),
seen AS (SELECT session_id, d, (SELECT count(*) FROM calls x WHERE x.session_id = drawn.session_id AND x.name = 'Write' AND x.k >= a AND x.k < a + 10) AS t,
  (SELECT count(*) FROM calls x WHERE x.session_id = drawn.session_id AND x.name = 'Write' AND x.is_error AND x.k >= a AND x.k < a + 10) AS f FROM drawn)"""


@query("failures_after_compaction", on_calls(PLACEBOS, """SELECT session_id, count(*) FILTER (WHERE d = 0) AS points, CAST(coalesce(sum(t) FILTER (WHERE d = 0), 0) AS BIGINT) AS tried, CAST(coalesce(sum(f) FILTER (WHERE d = 0), 0) AS BIGINT) AS failed,
  coalesce(sum(t) FILTER (WHERE d > 0), 0)::DOUBLE / 20 AS placebo_tried, coalesce(sum(f) FILTER (WHERE d > 0), 0)::DOUBLE / 20 AS placebo_failed FROM seen GROUP BY 1"""))
def failures_after_compaction(spark, sf):
    calls = tables.calls(spark, sf)
    return sensitivity.matched_placebos(calls, calls.where("is_compact = 1"), F.col("name") == "Write", F.col("is_error"))
