"""Conversation analysis, topic graph and ledger queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chat, graph, ledger
from ..sources import chats, tables
from .registry import MARKED, TURNS, query, with_views
from .text_queries import NODES, nodes, words_sql

RECEIPT = """p AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY idx) AS prev_role FROM turns),
kept AS (SELECT conv_id, idx, role, tokens FROM p WHERE role = 'user' OR prev_role = 'user'),
b AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY conv_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ctx FROM kept)"""


@query("conversation_receipts", with_views(f"{TURNS},\n{RECEIPT}", """SELECT conv_id, CAST(sum(CASE WHEN role = 'assistant' THEN ctx ELSE 0 END) AS BIGINT) AS billed_input,
  CAST(sum(CASE WHEN role = 'assistant' THEN tokens ELSE 0 END) AS BIGINT) AS billed_output FROM b GROUP BY conv_id"""))
def conversation_receipts(spark, sf):
    return chat.receipt(tables.turns(spark, sf))


@query("merged_roles", """WITH t AS (SELECT conv_id, turn, CASE WHEN role IN ('user', 'human') THEN 'user' WHEN role IN ('assistant', 'model', 'bot', 'ai') THEN 'assistant' END AS role, text FROM conversations WHERE length(trim(text)) > 0),
k AS (SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn) <> role, true)::INT AS fresh FROM t WHERE role IS NOT NULL),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM k),
m AS (SELECT conv_id, CAST(run - 1 AS BIGINT) AS idx, role, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM r GROUP BY conv_id, run, role)
SELECT conv_id, idx, role, md5(text) AS digest FROM m WHERE conv_id IN (SELECT conv_id FROM m WHERE role = 'user')""")
def merged_roles(spark, sf):
    c = tables.load(spark, sf, "conversations").withColumnRenamed("role", "role_raw")
    return chats.merge_roles(c, ["conv_id"], "turn").select("conv_id", "idx", "role", F.md5("text").alias("digest"))


FEATS = f"""{TURNS},
tw AS (SELECT conv_id, idx, role, {words_sql('text')} AS ws FROM turns),
tc AS (SELECT conv_id, idx, role, word, count(*) AS n FROM (SELECT conv_id, idx, role, unnest(ws) AS word FROM tw) GROUP BY ALL),
us AS (SELECT conv_id, count(*) AS user_turns, min(idx) AS first_idx FROM turns WHERE role = 'user' GROUP BY 1),
ks AS (SELECT conv_id, word, sum(CASE WHEN role = 'user' THEN n ELSE 0 END) AS u, count(*) FILTER (WHERE role = 'user') AS d, sum(CASE WHEN role = 'user' THEN 0 ELSE n END) AS a, any_value(user_turns) AS ut,
  bool_or(role = 'user' AND idx = first_idx) AS inf FROM tc JOIN us USING (conv_id) GROUP BY 1, 2),
kw0 AS (SELECT conv_id, word, round(2.0::DOUBLE * u + 1.5::DOUBLE * d + ln(1 + a::DOUBLE), 9) AS score FROM ks WHERE NOT (u = 0 AND a < 3) AND NOT (u = 1 AND a = 0 AND ut > 3 AND NOT inf)),
kw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, word) AS rank FROM kw0) WHERE rank <= 40)"""


def _words(spark, sf):
    f = chat.turn_words(tables.turns(spark, sf))
    counts = chat.word_counts(f)
    return f, counts, chat.keywords(f, counts)


@query("conversation_keywords", with_views(FEATS, "SELECT conv_id, word, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM kw"))
def conversation_keywords(spark, sf):
    return _words(spark, sf)[2].withColumn("score", F.round("score", 6))


@query("conversation_agenda", with_views(FEATS, "SELECT conv_id, string_agg(word, ',' ORDER BY rank) AS agenda FROM kw WHERE rank <= 7 GROUP BY 1"))
def conversation_agenda(spark, sf):
    a = chat.agenda(_words(spark, sf)[2])
    return a.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda e: e["word"]), ",").alias("agenda"))


TOPICS = f"""{FEATS},
topics AS (SELECT conv_id, idx, word, rank FROM (SELECT tc.conv_id, idx, word, role, row_number() OVER (PARTITION BY tc.conv_id, idx ORDER BY score DESC, word) - 1 AS rank FROM tc JOIN kw USING (conv_id, word)) WHERE rank < CASE WHEN role = 'user' THEN 5 ELSE 3 END)"""


@query("turn_topics", with_views(TOPICS, "SELECT conv_id, idx, word, CAST(rank AS INT) AS rank FROM topics"))
def turn_topics(spark, sf):
    _, counts, kw = _words(spark, sf)
    return chat.topics(counts, kw)


@query("thread_cues")
def thread_cues(spark, sf):
    return chat.cues(_words(spark, sf)[1])


@query("conversation_languages", with_views(TURNS, """SELECT conv_id, CASE WHEN greatest(2.0 * ko, 2.0 * ja, 2.0 * zh, 0.5 * en) <= 0 THEN 'und' WHEN 2.0 * ko = greatest(2.0 * ko, 2.0 * ja, 2.0 * zh, 0.5 * en) THEN 'ko'
  WHEN 2.0 * ja = greatest(2.0 * ko, 2.0 * ja, 2.0 * zh, 0.5 * en) THEN 'ja' WHEN 2.0 * zh = greatest(2.0 * ko, 2.0 * ja, 2.0 * zh, 0.5 * en) THEN 'zh' ELSE 'en' END AS language FROM (
  SELECT conv_id, sum(length(regexp_replace(substr(text, 1, 2000), '[^가-힣]', '', 'g'))) AS ko, sum(length(regexp_replace(substr(text, 1, 2000), '[^぀-ヿ]', '', 'g'))) AS ja,
  sum(length(regexp_replace(substr(text, 1, 2000), '[^一-鿿]', '', 'g'))) AS zh, sum(length(regexp_replace(substr(text, 1, 2000), '[^A-Za-z]', '', 'g'))) AS en FROM turns GROUP BY 1)"""))
def conversation_languages(spark, sf):
    return chat.language(tables.turns(spark, sf))


def jaccard_retries_sql(views: str, table: str, conv: str, idx: str, extra: str = "") -> str:
    return f"""WITH {views}
SELECT {conv}, {idx}, max(j) AS retry_of FROM (SELECT a.{conv}, a.{idx}, b.{idx} AS j FROM {table} a JOIN {table} b ON a.{conv} = b.{conv} AND b.{idx} < a.{idx} AND len(a.ws) >= 3 AND len(b.ws) > 0
  AND len(list_intersect(a.ws, b.ws))::DOUBLE / (len(a.ws) + len(b.ws) - len(list_intersect(a.ws, b.ws))) >= 0.8) GROUP BY 1, 2"""


@query("reasked_prompts", jaccard_retries_sql(f"{MARKED}, f AS (SELECT conv_id, idx, list_distinct({words_sql('text')}) AS ws FROM marked WHERE role = 'user')", "f", "conv_id", "idx"))
def reasked_prompts(spark, sf):
    return chat.retries(chat.turn_words(tables.marked_turns(spark, sf)), use_simhash=False)


@query("reasked_documents", jaccard_retries_sql(f"f AS (SELECT source, doc_id, list_distinct({words_sql('text')}) AS ws FROM documents)", "f", "source", "doc_id").replace("SELECT source, doc_id, max(j)", "SELECT source AS conv_id, doc_id AS idx, max(j)"))
def reasked_documents(spark, sf):
    """Documents of one source as the prompts of one conversation: copies and near copies."""
    d = tables.load(spark, sf, "documents").select(F.col("source").alias("conv_id"), F.col("doc_id").alias("idx"), "text", F.lit("user").alias("role"))
    return chat.retries(chat.turn_words(d), use_simhash=False)


@query("similar_prompts")
def similar_prompts(spark, sf):
    """Word sets and fingerprints together."""
    d = tables.load(spark, sf, "documents").select(F.col("source").alias("conv_id"), F.col("doc_id").alias("idx"), "text", F.lit("user").alias("role"))
    return chat.retries(chat.fingerprints(chat.turn_words(d)))


EXCH = f"""{NODES},
pr AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY idx) AS prev_role FROM nodes),
kp AS (SELECT *, CASE WHEN role = 'user' THEN branch ELSE lag(branch) OVER (PARTITION BY conv_id ORDER BY idx) END AS home FROM pr WHERE role = 'user' OR prev_role = 'user'),
rd AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY conv_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rd,
  coalesce(sum(tokens) OVER (PARTITION BY conv_id, home ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rh,
  lead(role) OVER w AS nr, lead(idx) OVER w AS ni, lead(tokens) OVER w AS nt FROM kp WINDOW w AS (PARTITION BY conv_id ORDER BY idx)),
ex0 AS (SELECT conv_id, idx, tokens, intent, branch, CASE WHEN nr = 'assistant' THEN ni END AS reply_idx, CASE WHEN nr = 'assistant' THEN nt END AS reply_tokens, CASE WHEN nr = 'assistant' THEN rd + tokens END AS reply_input,
  CASE WHEN nr = 'assistant' THEN rd - rh END AS drag, lead(intent) OVER (PARTITION BY conv_id ORDER BY idx) AS next_intent FROM rd WHERE role = 'user'),
ex AS (SELECT *, intent = 'ack' AS is_ack, reply_idx IS NOT NULL AND intent <> 'ack' AND coalesce(next_intent IN ('correct', 'retry'), false) AS superseded FROM ex0),
op AS (SELECT *, CASE WHEN NOT superseded THEN reply_tokens END AS kept FROM ex WHERE NOT is_ack AND NOT (superseded AND next_intent = 'retry')),
oq AS (SELECT *, coalesce(sum(tokens + coalesce(kept, 0)) OVER (PARTITION BY conv_id, branch ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bf FROM op),
os AS (SELECT conv_id, CAST(sum(CASE WHEN kept IS NOT NULL THEN bf + tokens ELSE 0 END) AS BIGINT) AS opt_input, CAST(sum(coalesce(kept, 0)) AS BIGINT) AS opt_output, CAST(sum(tokens) AS BIGINT) AS useful_user FROM oq GROUP BY 1)"""


def e(sql):
    return with_views(EXCH, sql)


@query("exchanges", e("SELECT conv_id, idx, reply_idx, CAST(reply_input AS BIGINT) AS reply_input, CAST(drag AS BIGINT) AS drag, is_ack, superseded FROM ex"))
def exchanges(spark, sf):
    return chat.exchanges(nodes(spark, sf)).select("conv_id", "idx", "reply_idx", "reply_input", "drag", "is_ack", "superseded")


@query("redundant_turns", e("SELECT conv_id, idx FROM ex WHERE (is_ack AND reply_idx IS NOT NULL) OR intent = 'retry' UNION ALL SELECT conv_id, reply_idx FROM ex WHERE reply_idx IS NOT NULL AND (is_ack OR superseded)"))
def redundant_turns(spark, sf):
    return chat.redundant_turns(chat.exchanges(nodes(spark, sf)))


@query("optimised_replay", e("SELECT * FROM os"))
def optimised_replay(spark, sf):
    return chat.optimised(chat.exchanges(nodes(spark, sf)))


METRICS = f"""{EXCH},
nm AS (SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS user_turns, count(*) FILTER (WHERE role = 'assistant') AS assistant_turns, sum(tokens) AS visible, coalesce(sum(tokens) FILTER (WHERE role = 'user'), 0) AS ut,
  coalesce(sum(tokens) FILTER (WHERE role = 'assistant'), 0) AS at_, max(depth) AS max_depth, count(DISTINCT branch) FILTER (WHERE role = 'user') AS branches FROM nodes GROUP BY 1),
xm AS (SELECT conv_id, coalesce(sum(reply_input), 0) AS bi, coalesce(sum(reply_tokens), 0) AS bo, coalesce(sum(reply_input * 0.25::DOUBLE + reply_tokens) FILTER (WHERE is_ack), 0) AS ack_units,
  coalesce(sum(reply_input * 0.25::DOUBLE + reply_tokens) FILTER (WHERE superseded), 0) AS sup_units, coalesce(sum(drag), 0) AS off FROM ex GROUP BY 1),
mx AS (SELECT *, bi * 0.25::DOUBLE + bo AS units, coalesce(opt_input, 0) * 0.25::DOUBLE + coalesce(opt_output, 0) AS opt_units, coalesce(useful_user, 0) * 0.25::DOUBLE + coalesce(opt_output, 0) AS one_units
  FROM nm JOIN xm USING (conv_id) LEFT JOIN os USING (conv_id))"""


@query("conversation_metrics", with_views(METRICS, """SELECT conv_id, CAST(user_turns AS BIGINT) AS user_turns, CAST(assistant_turns AS BIGINT) AS assistant_turns, CAST(visible AS BIGINT) AS visible_tokens, CAST(bi AS BIGINT) AS billed_input, CAST(bo AS BIGINT) AS billed_output,
  CAST(max_depth AS BIGINT) AS max_depth, CAST(branches AS BIGINT) AS branches, ack_units, sup_units AS superseded_units, CAST(off AS BIGINT) AS offtopic_tokens, units, opt_units, one_units AS one_shot_units,
  round(at_::DOUBLE / nullif(ut, 0), 6) AS verbosity_ratio, round(CASE WHEN units > 0 THEN 100 * (1 - opt_units / units) ELSE 0 END, 6) AS savings_pct, round(max_depth::DOUBLE / user_turns, 6) AS depth_efficiency, round(units / 1000 * 0.5, 6) AS energy_wh FROM mx WHERE user_turns > 0"""))
def conversation_metrics(spark, sf):
    m = chat.metrics(nodes(spark, sf))
    names = ["verbosity_ratio", "savings_pct", "depth_efficiency", "energy_wh"]
    return m.select("conv_id", "user_turns", "assistant_turns", "visible_tokens", "billed_input", "billed_output", "max_depth", "branches", "ack_units", "superseded_units", "offtopic_tokens", "units", "opt_units", "one_shot_units",
                    *[F.round(n, 6).alias(n) for n in names])


@query("intent_counts", with_views(NODES, "SELECT conv_id, intent, CAST(count(*) AS BIGINT) AS n FROM nodes GROUP BY ALL"))
def intent_counts(spark, sf):
    return chat.intent_counts(nodes(spark, sf))


@query("conversation_tips", with_views(METRICS, """SELECT conv_id, code, round(weight, 6)::DOUBLE AS weight, CAST(n AS BIGINT) AS n FROM (SELECT conv_id, unnest([
  {'code': 'ack', 'weight': CASE WHEN units > 0 THEN 100 * ack_units / units ELSE 0 END, 'n': n_ack, 'ok': n_ack > 0}, {'code': 'redo', 'weight': CASE WHEN units > 0 THEN 100 * sup_units / units ELSE 0 END, 'n': n_redo, 'ok': n_redo > 0},
  {'code': 'pivot', 'weight': CASE WHEN units > 0 THEN 100 * off * 0.25 / units ELSE 0 END, 'n': branches, 'ok': branches > 1},
  {'code': 'paste', 'weight': least(60.0, paste * later * 100.0::DOUBLE / greatest(1, bi)), 'n': later, 'ok': pidx IS NOT NULL}, {'code': 'verbose', 'weight': 10.0, 'n': at_, 'ok': coalesce(at_::DOUBLE / nullif(ut, 0), 0) > 8 AND at_ > 1500},
  {'code': 'continue', 'weight': 5.0, 'n': n_cont, 'ok': n_cont >= 2}, {'code': 'underspecified', 'weight': 5.0, 'n': n_fq, 'ok': n_fq >= 2}, {'code': 'long', 'weight': 5.0, 'n': user_turns, 'ok': user_turns > 20}], recursive := true)
  FROM mx JOIN (SELECT conv_id, count(*) FILTER (WHERE intent = 'ack') AS n_ack, count(*) FILTER (WHERE intent IN ('correct', 'retry')) AS n_redo, count(*) FILTER (WHERE intent = 'continue') AS n_cont, count(*) FILTER (WHERE intent = 'followup_question') AS n_fq,
    coalesce(sum(tokens) FILTER (WHERE intent = 'context'), 0) AS paste, min(idx) FILTER (WHERE intent = 'context' AND role = 'user') AS pidx, coalesce(sum((role = 'assistant' AND idx > (SELECT min(z.idx) FROM nodes z WHERE z.conv_id = n.conv_id AND z.intent = 'context'))::INT), 0) AS later
    FROM nodes n GROUP BY 1) USING (conv_id)) WHERE ok"""))
def conversation_tips(spark, sf):
    n = nodes(spark, sf)
    return chat.tips(chat.tip_inputs(n, chat.metrics(n))).withColumn("weight", F.round("weight", 6))


@query("corpus_impact", with_views(METRICS, """SELECT parity, size, CAST(count(*) AS BIGINT) AS conversations, CAST(sum(visible) AS BIGINT) AS visible_tokens, sum(units) AS units, sum(opt_units) AS opt_units, round(CASE WHEN sum(units) > 0 THEN 100 * (1 - sum(opt_units) / sum(units)) ELSE 0 END, 6) AS avoidable_pct
  FROM (SELECT *, CASE WHEN conv_id % 2 = 0 THEN 'even' ELSE 'odd' END AS parity, CASE WHEN user_turns > 2 THEN 'long' ELSE 'short' END AS size FROM mx) GROUP BY GROUPING SETS ((parity), (size), ())"""))
def corpus_impact(spark, sf):
    m = chat.metrics(nodes(spark, sf)).withColumns({"parity": F.when(F.col("conv_id") % 2 == 0, "even").otherwise("odd"), "size": F.when(F.col("user_turns") > 2, "long").otherwise("short")})
    return chat.impact(m, ["parity", "size"]).select("parity", "size", "conversations", "visible_tokens", "units", "opt_units", F.round("avoidable_pct", 6).alias("avoidable_pct"))


@query("order_edges", with_views(TURNS, """SELECT conv_id, lag(idx) OVER w AS src, idx AS dst, 'NEXT' AS type FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY idx) QUALIFY src IS NOT NULL
UNION ALL SELECT conv_id, idx, u, 'ANSWERS' FROM (SELECT *, max(CASE WHEN role = 'user' THEN idx END) OVER (PARTITION BY conv_id ORDER BY idx) AS u FROM turns) WHERE role = 'assistant' AND u IS NOT NULL"""))
def order_edges(spark, sf):
    return chat.order_edges(tables.turns(spark, sf))


def _analysis(spark, sf):
    return chat.analyse(tables.marked_turns(spark, sf))


@query("conversation_threads")
def conversation_threads(spark, sf):
    a = _analysis(spark, sf)
    return a["nodes"].select("conv_id", "idx", "role", "intent", "branch", "depth", "redundant")


@query("conversation_edges")
def conversation_edges(spark, sf):
    return _analysis(spark, sf)["edges"]


@query("prompt_skeletons")
def prompt_skeletons(spark, sf):
    return _analysis(spark, sf)["skeleton"]


@query("public_conversation_ids")
def public_conversation_ids(spark, sf):
    f = chat.fingerprints(chat.turn_words(tables.turns(spark, sf)), b"salt")
    return chat.conversation_ids(f, "salt")


# ---------------------------------------------------------------- graph

FACTS = f"""{TOPICS},
ag AS (SELECT conv_id, word, rank FROM kw WHERE rank <= 7),
ft AS (SELECT conv_id, word, sum(tokens) AS tokens FROM topics JOIN turns USING (conv_id, idx) GROUP BY 1, 2),
facts AS (SELECT * FROM ft UNION ALL SELECT conv_id, word, 0 FROM ag WHERE (conv_id, word) NOT IN (SELECT (conv_id, word) FROM ft)),
tt AS (SELECT word, count(*) AS conversations, sum(tokens) AS tokens FROM facts GROUP BY 1),
pub AS (SELECT * FROM tt WHERE conversations >= 3 ORDER BY conversations DESC, tokens DESC, word LIMIT 100),
co AS (SELECT a.word AS a, b.word AS b, count(*) AS n FROM ag a JOIN ag b ON a.conv_id = b.conv_id AND a.word < b.word GROUP BY 1, 2)"""


def _graph(spark, sf):
    f, counts, kw = _words(spark, sf)
    t = chat.topics(counts, kw)
    a = chat.agenda(kw)
    return f, t, a, graph.topic_facts(t, f, a)


@query("topic_totals", with_views(FACTS, "SELECT word, CAST(conversations AS BIGINT) AS conversations, CAST(tokens AS BIGINT) AS tokens FROM tt"))
def topic_totals(spark, sf):
    return graph.topic_totals(_graph(spark, sf)[3])


@query("topic_cooccurrence", with_views(FACTS, "SELECT a, b, CAST(n AS BIGINT) AS n FROM co"))
def topic_cooccurrence(spark, sf):
    return graph.cooccurrence(_graph(spark, sf)[2])


@query("public_topics", with_views(FACTS, "SELECT word, CAST(conversations AS BIGINT) AS conversations, CAST(tokens AS BIGINT) AS tokens FROM pub"))
def public_topics(spark, sf):
    return graph.public_topics(_graph(spark, sf)[3])


@query("public_topic_links", with_views(FACTS, "SELECT a, b, CAST(n AS BIGINT) AS n FROM co WHERE n >= 3 AND a IN (SELECT word FROM pub) AND b IN (SELECT word FROM pub)"))
def public_topic_links(spark, sf):
    _, _, a, facts = _graph(spark, sf)
    return graph.public_links(a, graph.public_topics(facts))


@query("graph_edges", with_views(FACTS, """SELECT 'conv:' || conv_id AS src, 'turn:' || conv_id || ':' || idx AS dst, 'HAS_TURN' AS type, NULL::BIGINT AS rank FROM turns
UNION ALL SELECT 'turn:' || conv_id || ':' || idx, 'topic:' || word, 'ABOUT', rank FROM topics UNION ALL SELECT 'conv:' || conv_id, 'topic:' || word, 'COVERS', rank - 1 FROM ag
UNION ALL SELECT 'turn:' || conv_id || ':' || p, 'turn:' || conv_id || ':' || idx, 'NEXT', NULL FROM (SELECT *, lag(idx) OVER (PARTITION BY conv_id ORDER BY idx) AS p FROM turns) WHERE p IS NOT NULL
UNION ALL SELECT 'turn:' || conv_id || ':' || idx, 'turn:' || conv_id || ':' || u, 'ANSWERS', NULL FROM (SELECT *, max(CASE WHEN role = 'user' THEN idx END) OVER (PARTITION BY conv_id ORDER BY idx) AS u FROM turns) WHERE role = 'assistant' AND u IS NOT NULL"""))
def graph_edges(spark, sf):
    f, t, a, _ = _graph(spark, sf)
    return graph.graph_edges(f, chat.order_edges(f), t, a)


@query("graph_nodes")
def graph_nodes(spark, sf):
    f, _, _, facts = _graph(spark, sf)
    return graph.graph_nodes(chat.receipt(f), f, facts)


@query("conversation_readback", with_views(TOPICS, "SELECT conv_id, idx, role, tokens, coalesce((SELECT string_agg(word, ',' ORDER BY rank) FROM topics x WHERE x.conv_id = t.conv_id AND x.idx = t.idx), '') AS topics FROM turns t"))
def conversation_readback(spark, sf):
    f, t, _, _ = _graph(spark, sf)
    return graph.read_back(f, t).select("conv_id", "idx", "role", "tokens", F.array_join("topics", ",").alias("topics"))


@query("conversations_once", "SELECT conv_id FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 3 <> 0")
def conversations_once(spark, sf):
    c = tables.load(spark, sf, "conversations").select("conv_id")
    return graph.contribute_once(c.where("conv_id % 3 = 0").distinct(), c)


@query("withdrawn_conversations", "SELECT conv_id FROM (SELECT DISTINCT conv_id FROM conversations) WHERE NOT (conv_id % 5 = 0 AND conv_id % 2 = 0)")
def withdrawn_conversations(spark, sf):
    """Every fifth conversation asks for deletion; half of the requests carry the right token."""
    ids = tables.load(spark, sf, "conversations").select("conv_id").distinct()
    stored = ids.withColumn("delete_token_hash", F.sha2(F.concat(F.lit("t"), F.col("conv_id").cast("string")), 256))
    asks = ids.where("conv_id % 5 = 0").withColumn("token", F.concat(F.when(F.col("conv_id") % 2 == 0, "t").otherwise("x"), F.col("conv_id").cast("string")))
    return graph.withdraw(stored, asks).select("conv_id")


@query("depth_by_intent_and_topic", with_views(f"{NODES}, {TOPICS[len(TURNS) + 1:]}", """SELECT word, intent, CAST(count(*) AS BIGINT) AS turns, avg(depth)::DOUBLE AS avg_depth FROM topics JOIN nodes USING (conv_id, idx) WHERE nodes.role = 'user' GROUP BY 1, 2"""))
def depth_by_intent_and_topic(spark, sf):
    _, t, _, _ = _graph(spark, sf)
    return graph.intents_before_deepest(nodes(spark, sf), t)


@query("latest_versions", "SELECT user_id, event_type, max_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2")
def latest_versions(spark, sf):
    ev = tables.load(spark, sf, "events").select("user_id", "event_type", "event_id", F.struct("ts", "event_id").alias("version"))
    return graph.upsert(ev.where("event_id % 2 = 0"), ev.where("event_id % 2 = 1"), ["user_id", "event_type"], "version").drop("version")


@query("conversation_cypher")
def conversation_cypher(spark, sf):
    a = _analysis(spark, sf)
    return graph.conversation_cypher(a["nodes"], a["edges"], a["topics"], a["agenda"])


@query("topic_cypher")
def topic_cypher(spark, sf):
    _, _, a, facts = _graph(spark, sf)
    t = graph.public_topics(facts)
    return graph.topics_cypher(t, graph.public_links(a, t))


@query("node_link_rows")
def node_link_rows(spark, sf):
    a = _analysis(spark, sf)
    return graph.node_link_rows(a["nodes"], a["edges"], a["topics"], a["agenda"])


# ---------------------------------------------------------------- requests and ledger


def _messages(spark, sf):
    """Each conversation's last request: everything up to its last prompt."""
    m = tables.marked_turns(spark, sf)
    last = m.where("role = 'user'").groupBy("conv_id").agg(F.max("idx").alias("end"))
    m = m.join(last, "conv_id").where("idx <= end")
    return m.select(F.col("conv_id").alias("request_id"), F.col("idx").alias("pos"), "role", "text", F.lit(True).alias("plain"))


def _requests(spark, sf):
    ids = _messages(spark, sf).select("request_id").distinct()
    return ids.withColumn("has_tools", F.col("request_id") % 7 == 0)


MSG = f"""{MARKED},
msgs AS (SELECT m.conv_id AS request_id, m.idx AS pos, role, text, tokens, tokens <= 12 AND regexp_matches(text, '^Thanks!$') AS thanks, lag(role) OVER w AS pr, lag(text) OVER w AS pt, lead(role) OVER w AS nr, lead(tokens) OVER w AS nt, lead(role, 2) OVER w AS n2
  FROM marked m JOIN (SELECT conv_id, max(idx) AS e FROM marked WHERE role = 'user' GROUP BY 1) USING (conv_id) WHERE m.idx <= e WINDOW w AS (PARTITION BY m.conv_id ORDER BY m.idx)),
est AS (SELECT request_id, count(*) AS n_messages, sum(tokens + 4) AS input_estimate, arg_max(tokens, pos) AS last_user_tokens FROM msgs GROUP BY 1),
gr AS (SELECT request_id, bool_or(nr IS NULL AND role = 'user' AND thanks AND pr = 'assistant' AND NOT (pt LIKE '%?')) AND request_id % 7 <> 0 AS gratitude_only FROM msgs GROUP BY 1),
cp AS (SELECT request_id, CASE WHEN request_id % 7 = 0 THEN 0 ELSE coalesce(sum(8 + tokens + nt) FILTER (WHERE role = 'user' AND thanks AND nr = 'assistant' AND nt <= 120 AND n2 IS NOT NULL), 0) END AS removed FROM msgs GROUP BY 1)"""


@query("request_estimates", with_views(MSG, "SELECT request_id, CAST(n_messages AS BIGINT) AS n_messages, CAST(input_estimate AS BIGINT) AS input_estimate, last_user_tokens, CAST(greatest(0, input_estimate - last_user_tokens) AS BIGINT) AS history_tokens FROM est"))
def request_estimates(spark, sf):
    return ledger.estimates(_messages(spark, sf))


@query("gratitude_requests", with_views(MSG, "SELECT request_id, coalesce(gratitude_only, false) AS gratitude_only FROM gr"))
def gratitude_requests(spark, sf):
    return ledger.gratitude_requests(_messages(spark, sf), _requests(spark, sf))


@query("thank_you_compaction", with_views(MSG, "SELECT request_id, CAST(removed AS BIGINT) AS removed FROM cp"))
def thank_you_compaction(spark, sf):
    return ledger.compactions(_messages(spark, sf), _requests(spark, sf))


def _log(spark, sf):
    """Events as request log rows."""
    ev = tables.load(spark, sf, "events")
    return ev.select(F.col("event_id").alias("request_id"), F.concat_ws("|", "user_id", "event_type").alias("key"), (F.unix_micros("ts") / 1e6).alias("at"), "ts",
                     F.when(F.col("user_id") % 2 == 0, "openai").otherwise("anthropic").alias("provider"), F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model"), "event_type", "value")


CACHE = """reqs AS (SELECT event_id AS request_id, user_id || '|' || event_type AS ky, epoch_us(ts) / 1e6::DOUBLE AS t, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS i FROM events),
hits AS (SELECT request_id, ky, i, t, t AS miss, false AS hit FROM reqs WHERE i = 1 UNION ALL SELECT r.request_id, r.ky, r.i, r.t, CASE WHEN r.t - h.miss > 86400 THEN r.t ELSE h.miss END, r.t - h.miss <= 86400 FROM hits h JOIN reqs r ON r.ky = h.ky AND r.i = h.i + 1)"""


@query("duplicate_requests", f"WITH RECURSIVE {CACHE} SELECT request_id, hit FROM hits")
def duplicate_requests(spark, sf):
    """A day's time to live, so that both hits and expiries occur."""
    return ledger.cache_hits(_log(spark, sf), ttl=86400.0)


LOG = """rq AS (SELECT event_id AS request_id, ts, CASE WHEN user_id % 2 = 0 THEN 'openai' ELSE 'anthropic' END AS provider, 'm' || (user_id % 3) AS model, CAST(floor(value) AS BIGINT) + 20 AS est, event_type = 'signup' AS gratitude, CASE WHEN event_type = 'view' THEN 6 ELSE 0 END AS removed,
  event_type = 'purchase' AS hit, event_type = 'error' AS failed, CASE WHEN event_id % 3 <> 0 THEN CAST(floor(value * 2) AS BIGINT) END AS uin, CASE WHEN event_id % 3 <> 0 THEN CAST(floor(value / 2) AS BIGINT) END AS uout FROM events),
oc AS (SELECT *, CASE WHEN gratitude THEN 'gratitude_local' WHEN hit THEN 'cache_hit' WHEN failed THEN 'error' WHEN removed > 0 THEN 'forwarded+compacted' ELSE 'forwarded' END AS action FROM rq),
led AS (SELECT *, action LIKE 'forwarded%' AS sent, CASE WHEN action LIKE 'forwarded%' THEN coalesce(uin, est - removed) ELSE 0 END AS input_tokens, CASE WHEN action LIKE 'forwarded%' THEN coalesce(uout, 0) ELSE 0 END AS output_tokens,
  CASE WHEN gratitude OR hit THEN est WHEN action LIKE 'forwarded%' THEN removed ELSE 0 END AS avoided_input, CASE WHEN gratitude THEN 40 WHEN hit THEN coalesce(uout, 0) ELSE 0 END AS avoided_output,
  CASE WHEN action LIKE 'forwarded%' THEN greatest(0, coalesce(uin, est - removed) - 10) ELSE 0 END AS history_tokens, (action LIKE 'forwarded%' AND uin IS NOT NULL)::INT AS measured FROM oc)"""


def _outcomes(spark, sf):
    r = _log(spark, sf)
    n = lambda c: F.floor(c).cast("bigint")
    known = F.col("request_id") % 3 != 0
    r = r.withColumns({"input_estimate": n(F.col("value")) + 20, "last_user_tokens": F.lit(10), "gratitude_only": F.col("event_type") == "signup", "removed": F.when(F.col("event_type") == "view", 6).otherwise(0),
                       "hit": F.col("event_type") == "purchase", "failed": F.col("event_type") == "error", "usage_input": F.when(known, n(F.col("value") * 2)), "usage_output": F.when(known, n(F.col("value") / 2)), "streamed": F.lit(False)})
    return ledger.outcomes(r)


@query("request_outcomes", with_views(LOG, "SELECT request_id, action, CAST(input_tokens AS BIGINT) AS input_tokens, CAST(output_tokens AS BIGINT) AS output_tokens, CAST(avoided_input AS BIGINT) AS avoided_input, CAST(avoided_output AS BIGINT) AS avoided_output, CAST(history_tokens AS BIGINT) AS history_tokens, measured = 1 AS measured FROM led"))
def request_outcomes(spark, sf):
    return _outcomes(spark, sf).select("request_id", "action", "input_tokens", "output_tokens", "avoided_input", "avoided_output", "history_tokens", "measured")


def _ledger(spark, sf):
    return ledger.ledger(_outcomes(spark, sf))


@query("ledger_summary", with_views(LOG, """SELECT provider, model, action, CAST(grouping(provider, model, action) AS BIGINT) AS level, CAST(count(*) AS BIGINT) AS requests, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
  CAST(sum(history_tokens) AS BIGINT) AS history_tokens, CAST(sum(avoided_input) AS BIGINT) AS avoided_input, CAST(sum(measured) AS BIGINT) AS measured_requests, CASE WHEN sum(input_tokens) > 0 THEN 100.0::DOUBLE * sum(history_tokens) / sum(input_tokens) ELSE 0 END AS history_share_pct,
  CASE WHEN sum(input_tokens + output_tokens + avoided_input + avoided_output) > 0 THEN 100.0::DOUBLE * sum(avoided_input + avoided_output) / sum(input_tokens + output_tokens + avoided_input + avoided_output) ELSE 0 END AS avoided_pct FROM led GROUP BY ROLLUP (provider, model, action)"""))
def ledger_summary(spark, sf):
    return ledger.summary(_ledger(spark, sf)).select("provider", "model", "action", "level", "requests", "input_tokens", "output_tokens", "history_tokens", "avoided_input", "measured_requests", "history_share_pct", "avoided_pct")


@query("ledger_daily", with_views(LOG, "SELECT CAST(ts AS DATE) AS day, provider, model, action, CAST(count(*) AS BIGINT) AS requests, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(0 AS BIGINT) AS reasoning_tokens, CAST(sum(history_tokens) AS BIGINT) AS history_tokens, CAST(sum(avoided_input) AS BIGINT) AS avoided_input, CAST(sum(avoided_output) AS BIGINT) AS avoided_output, CAST(sum(measured) AS BIGINT) AS measured_requests FROM led GROUP BY ALL"))
def ledger_daily(spark, sf):
    return ledger.daily(_ledger(spark, sf))


@query("canonical_request_keys", "SELECT key_count FROM (SELECT CAST(count(DISTINCT (user_id, event_type)) AS BIGINT) AS key_count FROM events)")
def canonical_request_keys(spark, sf):
    """Bodies that differ only in volatile keys and in key order, also inside messages, have one key."""
    ev = tables.load(spark, sf, "events")
    body = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"model":"m'), F.col("user_id").cast("string"), F.lit('","messages":[{"role":"user","content":"'), "event_type", F.lit('"}],"stream":true}'))) \
        .otherwise(F.concat(F.lit('{"user":"u","messages":[{"content":"'), "event_type", F.lit('","role":"user"}],"model":"m'), F.col("user_id").cast("string"), F.lit('"}')))
    return ev.select(ledger.request_key(F.lit("openai"), body).alias("k")).agg(F.count_distinct("k").alias("key_count"))
