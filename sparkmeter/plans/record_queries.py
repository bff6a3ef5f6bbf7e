"""Contributions, label agreement, benchmark replies, curated rows and digests."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import scale
from ..operators import bench, chat, contrib, labels, survey
from ..sources import sinks, tables
from .chat_queries import _ledger
from .registry import CALLS, query, with_views
from .text_queries import nodes

L = F.lit


# ---------------------------------------------------------------- agreement of two coders


def _coders(spark, sf):
    """The two label columns read as two coders of the same items."""
    l = tables.load(spark, sf, "labels")
    yes = lambda c: F.when(F.col(c) == 1, "yes").otherwise("no")
    base = [L("p").alias("packet"), L("main").alias("phase"), F.col("doc_id").alias("item"), F.concat(L("W"), (F.col("doc_id") % 4 + 1).cast("string")).alias("category")]
    return l.select(*base, yes("quality").alias("choice")), l.select(*base, yes("toxic").alias("choice"))


KAPPA = """lb AS (SELECT doc_id, 'W' || (doc_id % 4 + 1) AS category, CASE WHEN quality = 1 THEN 'yes' ELSE 'no' END AS a, CASE WHEN toxic = 1 THEN 'yes' ELSE 'no' END AS b FROM labels),
kq AS (SELECT category, count(*) AS n, count(*) FILTER (WHERE a = b)::DOUBLE / count(*) AS po, (count(*) FILTER (WHERE a = 'yes') * count(*) FILTER (WHERE b = 'yes') + count(*) FILTER (WHERE a = 'no') * count(*) FILTER (WHERE b = 'no'))::DOUBLE / (count(*) * count(*)) AS pe FROM lb GROUP BY 1)"""


@query("label_agreement", with_views(KAPPA, "SELECT category, CAST(n AS BIGINT) AS n, round(100 * po, 6) AS agree_pct, round((po - pe) / (1 - pe), 6) AS kappa, coalesce((po - pe) / (1 - pe) >= 0.7, false) AS passes FROM kq"))
def label_agreement(spark, sf):
    a = labels.agreement(*_coders(spark, sf))
    return a.select("category", "n", F.round("agree_pct", 6).alias("agree_pct"), F.round("kappa", 6).alias("kappa"), "passes")


@query("label_disagreements", with_views(KAPPA, "SELECT category, doc_id AS item, a, b FROM lb WHERE a <> b"))
def label_disagreements(spark, sf):
    return labels.disagreements(*_coders(spark, sf))


@query("invalid_label_cells", "SELECT doc_id || '.' || CASE WHEN doc_id % 3 = 0 THEN 'W9' ELSE 'outcome' END AS error FROM labels WHERE doc_id % 3 <> 1 AND (doc_id % 3 = 0 OR toxic = 1)")
def invalid_label_cells(spark, sf):
    l = tables.load(spark, sf, "labels")
    n = F.col("doc_id") % 3
    rows = l.select(F.col("doc_id").alias("item"), F.when(n == 0, "W9").when(n == 1, "W2").otherwise("outcome").alias("category"),
                    F.when(n == 2, F.when(F.col("toxic") == 1, "maybe").otherwise("met")).otherwise("no").alias("choice"))
    return labels.bad_cells(rows)


@query("unseen_items", "SELECT doc_id AS session_id, 0::BIGINT AS idx FROM labels WHERE quality = 0")
def unseen_items(spark, sf):
    """Items already shown (quality 1) stay out of the next sample."""
    l = tables.load(spark, sf, "labels")
    items = l.select(F.col("doc_id").alias("session_id"), L(1).cast("bigint").alias("instr"), L(1).alias("calls"), F.col("toxic").cast("bigint").alias("input"))
    shown = l.where("quality = 1").select(F.col("doc_id").alias("session_id"), L(0).cast("bigint").alias("idx"))
    return labels.sampling_frame(items, shown).select("session_id", "idx")


# ---------------------------------------------------------------- contributions


def _skeletons(spark, sf):
    """Every conversation as a contributed skeleton; every fifth one with a fault put in."""
    n = nodes(spark, sf)
    x = chat.exchanges(n)
    red = chat.redundant_turns(x).distinct().withColumn("redundant", L(True))
    full = n.join(red, ["conv_id", "idx"], "left").fillna(False, ["redundant"])
    m = chat.metrics(n, x)
    p = contrib.skeleton_payload(m, full, chat.order_edges(n), chat.language(n))
    bad = F.when(F.col("conv_id") % 5 == 0, F.regexp_replace("payload", '"max_depth":', '"max_dept":')).when(F.col("conv_id") % 5 == 1, F.regexp_replace("payload", '"language":"en"', '"language":"xx"')).otherwise(F.col("payload"))
    return p.select(F.col("conv_id").alias("id"), bad.alias("payload"), (F.col("conv_id") % 2 == 0).alias("verified"))


@query("contribution_errors")
def contribution_errors(spark, sf):
    v = contrib.validate(_skeletons(spark, sf), kinds=["skeleton"])
    return v.select("id", F.explode("errors").alias("error"))


@query("ledger_contribution_errors", "SELECT CAST(0 AS BIGINT) AS bad, CAST(ceil(count(*) / 100.0) AS BIGINT) AS payloads FROM (SELECT DISTINCT CAST(ts AS DATE), user_id % 2, user_id % 3, event_type FROM events)")
def ledger_contribution_errors(spark, sf):
    """Daily ledger rows in envelopes of a hundred, all of them valid."""
    from ..operators import ledger

    v = contrib.validate(contrib.ledger_payload(ledger.daily(_ledger(spark, sf))), kinds=["ledger"])
    return v.agg(F.count(F.when(F.size("errors") > 0, 1)).alias("bad"), F.count(L(1)).alias("payloads"))


@query("agent_contribution_errors", "SELECT error FROM (SELECT 'none' AS error) WHERE false")
def agent_contribution_errors(spark, sf):
    from ..operators import audit
    from .call_queries import EV

    calls, uses = tables.calls(spark, sf), tables.tool_uses(spark, sf)
    tools = audit.by_tool(audit.with_carry(uses, calls)).groupBy(F.when(F.col("name").startswith("mcp__"), "mcp").otherwise(F.col("name")).alias("name")).agg(*[F.sum(c).alias(c) for c in contrib.AGENT_TOOL])
    p = contrib.agent_payload(audit.merge(audit.audit(calls, uses, EV)), tools)
    return contrib.validate(p, kinds=["agent"]).select(F.explode("errors").alias("error"))


def _valid(spark, sf):
    return scale.materialize(contrib.valid(_skeletons(spark, sf), kinds=["skeleton"]))  # aggregated several ways


@query("contribution_counts")
def contribution_counts(spark, sf):
    return contrib.contribution_counts(_valid(spark, sf))


@query("skeleton_aggregate")
def skeleton_aggregate(spark, sf):
    return contrib.skeleton_aggregate(_valid(spark, sf))


@query("skeleton_counts")
def skeleton_counts(spark, sf):
    return contrib.skeleton_counts(_valid(spark, sf))


@query("ledger_aggregate", """WITH r AS (SELECT event_type, value, event_id % 3 <> 0 AS known FROM events),
l AS (SELECT CASE event_type WHEN 'signup' THEN 'gratitude_local' WHEN 'purchase' THEN 'cache_hit' WHEN 'error' THEN 'error' WHEN 'view' THEN 'forwarded+compacted' ELSE 'forwarded' END AS action, (event_type IN ('view', 'click') AND known)::INT AS m FROM r)
SELECT action, CAST(count(*) AS BIGINT) AS requests, CAST(sum(m) AS BIGINT) AS measured_requests FROM l GROUP BY GROUPING SETS ((action), ())""")
def ledger_aggregate(spark, sf):
    from ..operators import ledger

    p = contrib.ledger_payload(ledger.daily(_ledger(spark, sf)))
    return contrib.ledger_aggregate(p).select("action", "requests", "measured_requests")


def _labels(spark, sf):
    """The three longest words of each document's first line as its contributed labels."""
    d = tables.load(spark, sf, "documents")
    words = F.slice(F.array_distinct(F.regexp_extract_all(F.lower(F.substring_index("text", "\n", 1)), F.lit("[a-z]{3,}"), F.lit(0))), 1, 5)
    return d.select(F.col("doc_id").alias("id"), F.explode(words).alias("label"))


LABELS = """lw AS (SELECT doc_id AS id, unnest(list_distinct(w)) AS label FROM (SELECT doc_id, list_filter(regexp_extract_all(lower(split_part(text, chr(10), 1)), '[a-z]{3,}'), lambda x, i: list_position(regexp_extract_all(lower(split_part(text, chr(10), 1)), '[a-z]{3,}'), x) = i)[1:5] AS w FROM documents)),
lc AS (SELECT label, count(*) AS n FROM lw GROUP BY 1), lp AS (SELECT a.label AS a, b.label AS b, count(*) AS n FROM lw a JOIN lw b ON a.id = b.id AND a.label < b.label GROUP BY 1, 2)"""


@query("shared_labels", with_views(LABELS, "SELECT label, CAST(n AS BIGINT) AS n FROM lc WHERE n >= 3 ORDER BY n DESC, label LIMIT 100"))
def shared_labels(spark, sf):
    return contrib.label_counts(_labels(spark, sf))


@query("shared_label_pairs", with_views(LABELS, "SELECT a, b, CAST(n AS BIGINT) AS n FROM lp WHERE n >= 3 ORDER BY n DESC, a, b LIMIT 300"))
def shared_label_pairs(spark, sf):
    return contrib.label_pairs(_labels(spark, sf))


@query("contributions_left", "SELECT doc_id AS id FROM documents WHERE NOT (doc_id % 4 = 0 AND doc_id % 8 <> 4)")
def contributions_left(spark, sf):
    """Every fourth asks to be withdrawn: some by author, some by token, some with neither right."""
    d = tables.load(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.concat(L("a"), "doc_id").alias("author"), F.sha2(F.concat(L("t"), "doc_id"), 256).alias("token_hash"))
    r = d.where("id % 4 = 0").select("id", F.when(F.col("id") % 8 == 4, "someone").when(F.col("id") % 16 == 0, F.col("author")).alias("author"), F.when(F.col("id") % 8 == 4, "wrong").otherwise(F.concat(L("t"), "id")).alias("token"))
    return contrib.withdraw(d, r).select("id")


@query("contribution_page", "SELECT doc_id AS seq FROM documents WHERE doc_id > 100 ORDER BY doc_id LIMIT 50")
def contribution_page(spark, sf):
    return contrib.page_after(tables.load(spark, sf, "documents").select(F.col("doc_id").alias("seq")), 100, 50)


# ---------------------------------------------------------------- benchmark replies and curated rows


def _replies(spark, sf):
    """Each user's events as replies to the task of the same number."""
    e = tables.load(spark, sf, "events")
    tasks = bench.task_table(spark)
    ids = F.array(*[L(t[0]) for t in bench.TASKS])
    e = e.select(F.concat(L("m"), (F.col("user_id") % 4).cast("string")).alias("model"), F.col("event_type").alias("settings"), F.element_at(ids, (F.col("event_id") % 30 + 1).cast("int")).alias("id"),
                 (F.col("event_id") % 30).cast("int").alias("no"), F.floor("value").cast("bigint").alias("completion_tokens"), F.lit(0).cast("bigint").alias("reasoning_tokens"), "event_id")
    answers = F.array(*[L(t[1]) for t in bench.TASKS])
    reply = F.when(F.col("event_id") % 4 == 0, "I do not know").otherwise(F.concat(L("It is **"), F.element_at(answers, F.col("no") + 1), L("**.")))
    return e.withColumn("reply", reply), tasks


_ANS = ", ".join(f"'{t[1]}'" for t in bench.TASKS)
GRADED = f"""gd AS (SELECT 'm' || (user_id % 4) AS model, event_type AS settings, event_id % 4 <> 0 AS correct, CAST(floor(value) AS BIGINT) AS spent, [{_ANS}][event_id % 30 + 1] AS answer FROM events)"""


@query("graded_replies", with_views(GRADED, "SELECT model, settings, CAST(count(*) AS BIGINT) AS replies, CAST(count(*) FILTER (WHERE correct) AS BIGINT) AS correct FROM gd GROUP BY 1, 2"))
def graded_replies(spark, sf):
    r, tasks = _replies(spark, sf)
    return bench.grade(r, tasks).groupBy("model", "settings").agg(F.count(L(1)).alias("replies"), F.count(F.when(F.col("correct"), 1)).alias("correct"))


@query("benchmark_summary", with_views(GRADED, """SELECT model, settings, CAST(count(*) AS BIGINT) AS tasks, count(*) FILTER (WHERE correct)::DOUBLE / count(*) AS accuracy, sum(spent) FILTER (WHERE correct)::DOUBLE / count(*) FILTER (WHERE correct) AS completion_tokens_per_correct,
  round(1 - sum(greatest(1, CASE WHEN answer = '서울' THEN 2 ELSE ceil(length(answer) / 4.0) END)) FILTER (WHERE correct)::DOUBLE / sum(spent) FILTER (WHERE correct), 9) AS overcompute_ratio FROM gd GROUP BY 1, 2"""))
def benchmark_summary(spark, sf):
    r, tasks = _replies(spark, sf)
    return bench.summarize(bench.grade(r, tasks)).select("model", "settings", "tasks", "accuracy", "completion_tokens_per_correct", F.round("overcompute_ratio", 9).alias("overcompute_ratio"))


@query("benchmark_coverage_errors", """WITH r AS (SELECT user_id AS result, event_id % 31 AS t FROM events)
SELECT result, 'rows do not cover exactly the task set' AS error FROM r GROUP BY result HAVING count(*) <> count(DISTINCT t) OR count(*) FILTER (WHERE t = 30) > 0 OR count(DISTINCT t) FILTER (WHERE t < 30) < 30""")
def benchmark_coverage_errors(spark, sf):
    ids = F.array(*[L(t[0]) for t in bench.TASKS], L("unknown"))
    e = tables.load(spark, sf, "events").select(F.col("user_id").alias("result"), F.element_at(ids, (F.col("event_id") % 31 + 1).cast("int")).alias("id"), F.floor("value").cast("bigint").alias("completion_tokens"))
    return bench.result_errors(e, bench.task_table(spark))


@query("duplicate_results", """WITH r AS (SELECT page_id AS result, 'k' || (page_id % 40) AS key FROM pages), f AS (SELECT key, min(result) AS kept FROM r GROUP BY 1)
SELECT result, 'duplicate of ' || kept AS error FROM r JOIN f USING (key) WHERE result <> kept""")
def duplicate_results(spark, sf):
    r = tables.load(spark, sf, "pages").select(F.col("page_id").alias("result"), F.concat(L("k"), (F.col("page_id") % 40).cast("string")).alias("key"))
    return bench.duplicate_results(r)


@query("curated_row_errors", """WITH r AS (SELECT page_id + 2 AS line, page_id % 7 AS c, url FROM pages)
SELECT line, CASE c WHEN 0 THEN 'missing unit' WHEN 1 THEN 'id must be lowercase slug' WHEN 2 THEN 'unknown metric profit' WHEN 3 THEN 'value must be numeric' WHEN 4 THEN 'accessed must be YYYY-MM-DD' WHEN 5 THEN 'verifier must differ from curator' END AS error FROM r WHERE c < 6
UNION ALL SELECT line, 'source_url must be https' FROM r WHERE NOT starts_with(url, 'https://')""")
def curated_row_errors(spark, sf):
    c = F.col("page_id") % 7
    p = F.col("page_id").cast("string")
    pick = lambda k, bad, good: F.when(c == k, bad).otherwise(good)
    rows = tables.load(spark, sf, "pages").select(
        (F.col("page_id") + 2).alias("line"), pick(1, F.concat(L("Row_"), p), F.concat(L("row-"), p)).alias("id"), L("Acme").alias("entity"), pick(2, L("profit"), L("capex_ai")).alias("metric"), pick(3, L("many"), L("12.5")).alias("value"),
        pick(0, L(" "), L("usd")).alias("unit"), L("2025-01-01").alias("period_start"), L("2025-03-31").alias("period_end"), L("reported").alias("grade"), F.col("url").alias("source_url"), L("Report").alias("source_title"),
        pick(4, L("2025-02-30"), L("2025-02-28")).alias("accessed"), L("ann").alias("curator"), pick(5, L("ann"), L("bob")).alias("verifier"), L("").alias("notes"))
    return bench.index_errors(rows)


@query("capital_ratios", "SELECT strftime(o_orderdate, '%Y') AS period_start, round(sum(CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END) / sum(CASE WHEN o_orderkey % 2 = 1 THEN o_totalprice END), 9) AS k FROM orders GROUP BY 1")
def capital_ratios(spark, sf):
    """Orders of even key as revenue, of odd key as investment."""
    o = tables.load(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy").alias("period_start"), F.when(F.col("o_orderkey") % 2 == 0, "revenue_ai").otherwise("capex_ai").alias("metric"), F.col("o_totalprice").cast("string").alias("value"))
    return bench.capital_ratio(o).select("period_start", F.round("k", 9).alias("k"))


@query("effective_compute", "SELECT source, round(avg(quality) * (1 - avg(toxic)) * (1 - 0.25), 9)::DOUBLE AS e FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def effective_compute(spark, sf):
    d = tables.load(spark, sf, "documents").select("doc_id", "source").join(tables.load(spark, sf, "labels"), "doc_id")
    return d.groupBy("source").agg(F.round(bench.index_value(F.avg("quality"), F.avg("toxic"), L(0.25)), 9).alias("e"))


# ---------------------------------------------------------------- digests and report tables


@query("dataset_digest", with_views(CALLS, """d AS (SELECT sha256('{"calls":' || count(*) || ',"input":' || sum(context) || ',"session_id":' || session_id || '}') AS h FROM calls GROUP BY session_id),
p AS (SELECT substr(h, 1, 4) AS p, sha256(string_agg(h, chr(10) ORDER BY h)) AS d, count(*) AS n FROM d GROUP BY 1) SELECT sha256(string_agg(d, chr(10) ORDER BY d)) AS digest, CAST(sum(n) AS BIGINT) AS rows FROM p"""))
def dataset_digest(spark, sf):
    s = tables.calls(spark, sf).groupBy("session_id").agg(F.count(L(1)).alias("calls"), F.sum("context").alias("input"))
    return sinks.dataset_digest(s)


@query("steps_and_context", with_views(CALLS, "SELECT session_id, instr, CAST(count(*) AS BIGINT) AS calls, sum(context)::DOUBLE / count(*) AS mean_context FROM calls WHERE instr >= 1 GROUP BY 1, 2"))
def steps_and_context(spark, sf):
    """The numbers behind the steps-by-context chart."""
    p = survey.per_instruction(tables.calls(spark, sf))
    return p.select("session_id", "instr", "calls", (F.col("input") / F.col("calls")).alias("mean_context"))


@query("sawtooth", with_views(CALLS, "SELECT session_id, epoch, CAST(min(context) AS BIGINT) AS low, CAST(max(context) AS BIGINT) AS high, CAST(count(*) AS BIGINT) AS calls FROM calls GROUP BY 1, 2"))
def sawtooth(spark, sf):
    return tables.calls(spark, sf).groupBy("session_id", "epoch").agg(F.min("context").alias("low"), F.max("context").alias("high"), F.count(L(1)).alias("calls"))
