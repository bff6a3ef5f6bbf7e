"""Offline bound and online policies over conversations read as traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import scale
from ..operators import bound, policy, rules
from ..sources import tables
from .registry import TURNS, query, with_views

TERM = r"'[A-Za-z_][A-Za-z0-9_./\-]{5,}|[가-힣]{3,}|[0-9]{4,}'"
TRACE = f"""{TURNS},
tr AS (SELECT conv_id, idx, role, tokens, list_distinct(regexp_extract_all(text, {TERM})) AS terms, CAST(count(*) FILTER (WHERE role = 'assistant') OVER w AS BIGINT) AS replies,
  CAST(coalesce(sum(tokens) OVER (PARTITION BY conv_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS context FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY idx)),
cl AS (SELECT conv_id, replies - 1 AS k, context FROM tr WHERE role = 'assistant'),
n AS (SELECT conv_id, count(*) AS n_calls, sum(context) AS measured FROM cl GROUP BY 1),
ct AS (SELECT conv_id, replies - 1 AS k, unnest(terms) AS term FROM tr WHERE role = 'assistant'),
tf AS (SELECT conv_id, term, count(DISTINCT k) AS df FROM ct GROUP BY 1, 2),
ac AS (SELECT conv_id, count(DISTINCT k) AS active FROM ct GROUP BY 1),
ui AS (SELECT ct.conv_id, k, term, df, active FROM ct JOIN tf USING (conv_id, term) JOIN ac USING (conv_id)),
sg AS (SELECT conv_id, idx AS seg_id, CASE WHEN role = 'assistant' THEN 'assistant_text' ELSE 'user_prompt' END AS kind, tokens::DOUBLE AS tokens, replies AS birth, terms, CASE WHEN replies < coalesce(n_calls, 0) THEN n_calls ELSE replies END AS e
  FROM tr LEFT JOIN n USING (conv_id) WHERE tokens > 0),
sh AS (SELECT s.conv_id, seg_id, tokens, k, count(*) FILTER (WHERE df <= greatest(3, 0.01 * active)) AS s0, count(*) FILTER (WHERE df <= greatest(3, 0.02 * active)) AS s1, count(*) FILTER (WHERE df <= greatest(3, 0.05 * active)) AS s2
  FROM (SELECT conv_id, seg_id, tokens, birth, e, unnest(terms) AS term FROM sg) s JOIN ui USING (conv_id, term) WHERE k > birth AND k < e GROUP BY ALL),
rf AS (SELECT conv_id, seg_id, tokens, birth AS k FROM sg WHERE birth < e UNION ALL SELECT conv_id, seg_id, tokens, k FROM sh WHERE s1 >= 1),
gp AS (SELECT *, k - lag(k) OVER (PARTITION BY conv_id, seg_id ORDER BY k) AS gap, min(k) OVER (PARTITION BY conv_id, seg_id) AS birth FROM rf),
us AS (SELECT conv_id, seg_id, count(*) AS m, max(k) AS last, coalesce(sum(CASE WHEN gap IS NOT NULL THEN least(tokens * (gap - 1), 0.0) END), 0) AS g0, coalesce(sum(CASE WHEN gap IS NOT NULL THEN least(tokens * (gap - 1), 1000.0) END), 0) AS g1, coalesce(sum(CASE WHEN gap IS NOT NULL THEN least(tokens * (gap - 1), 10000.0) END), 0) AS g2, coalesce(sum(tokens * (gap - 1)), 0) AS g3 FROM gp GROUP BY 1, 2),
nd AS (SELECT s.*, m, last, s.tokens * (s.e - s.birth) AS resident, coalesce(s.tokens * m + g0, 0) AS n0, coalesce(s.tokens * m + g1, 0) AS n1, coalesce(s.tokens * m + g2, 0) AS n2, coalesce(s.tokens * m + g3, 0) AS n3 FROM sg s LEFT JOIN us USING (conv_id, seg_id)),
bd AS (SELECT conv_id AS session_id, any_value(n_calls) AS api_calls, any_value(measured) AS measured, sum(resident) AS resident, sum(n0) AS n0, sum(n1) AS n1, sum(n2) AS n2, sum(n3) AS n3 FROM nd JOIN n USING (conv_id) GROUP BY 1)"""


def t(sql: str) -> str:
    return with_views(TRACE, sql)


def _trace(spark, sf):
    return tables.chat_segments(tables.turns(spark, sf))


def _linked(spark, sf, **kw):
    segs, terms, calls = _trace(spark, sf)
    wins, refs = bound.link(segs, terms, calls, **kw)
    return wins, refs, calls, terms


def _needs(spark, sf):
    wins, refs, calls, _ = _linked(spark, sf)
    refs = scale.materialize(refs)  # read for the needs, and again by policies and carried parts
    return bound.segment_needs(wins, refs), refs, calls


@query("chat_traces", t("SELECT conv_id AS session_id, k, context FROM cl"))
def chat_traces(spark, sf):
    return _trace(spark, sf)[2].select("session_id", "k", "context")


@query("common_terms", t("SELECT conv_id AS session_id, term, CAST(df AS BIGINT) AS df FROM tf JOIN ac USING (conv_id) WHERE df > greatest(3, 0.02 * active)"))
def common_terms(spark, sf):
    return bound.term_frequency(_trace(spark, sf)[1]).where(bound.is_common(0.02)).select("session_id", "term", "df")


@query("use_index", t("SELECT conv_id AS session_id, k, term FROM ui WHERE df <= greatest(3, 0.02 * active)"))
def use_index(spark, sf):
    return bound.use_index(_trace(spark, sf)[1], 0.02).select("session_id", "k", "term")


@query("residency_windows", t("SELECT conv_id AS session_id, seg_id, kind, birth, e AS \"end\" FROM sg"))
def residency_windows(spark, sf):
    segs, _, calls = _trace(spark, sf)
    return bound.windows(segs, calls).select("session_id", "seg_id", "kind", "birth", "end")


@query("lexical_links", t("SELECT conv_id AS session_id, seg_id, k FROM rf"))
def lexical_links(spark, sf):
    return _linked(spark, sf)[1].select("session_id", "seg_id", "k")


@query("lexical_links_two_terms", t("SELECT conv_id AS session_id, seg_id, birth AS k FROM sg WHERE birth < e UNION ALL SELECT conv_id, seg_id, k FROM sh WHERE s2 >= 2"))
def lexical_links_two_terms(spark, sf):
    return _linked(spark, sf, min_shared=2, common_frac=0.05)[1].select("session_id", "seg_id", "k")


@query("mirror_test", t("""SELECT session_id, seg_id, CAST(n_obs AS BIGINT) AS n_obs, CAST(w AS BIGINT) AS w, CAST(hit AS BIGINT) AS hit, CAST(avail AS BIGINT) AS avail, avail = 0 AS fallback, n_obs > p * w + 2 * sqrt(w * p * (1 - p)) AS kept FROM (
  SELECT conv_id AS session_id, seg_id, w, hit, avail, CASE WHEN avail > 0 THEN hit::DOUBLE / avail ELSE coalesce(sum(hit) OVER pk::DOUBLE / nullif(sum(avail) OVER pk, 0), 0) END AS p, (SELECT count(*) FROM sh WHERE sh.conv_id = x.conv_id AND sh.seg_id = x.seg_id AND s1 >= 1) AS n_obs FROM (
    SELECT y.*, (SELECT count(DISTINCT k) FROM ui WHERE ui.conv_id = y.conv_id AND df <= greatest(3, 0.02 * active) AND list_contains(y.terms, term) AND k >= lo AND k < o) AS hit, greatest(0, o - lo) AS avail FROM (
      SELECT *, greatest(0, o - w) AS lo FROM (SELECT *, CASE WHEN kind = 'user_prompt' THEN birth ELSE birth - 1 END AS o, e - birth - 1 AS w FROM sg WHERE birth < e)) y) x WINDOW pk AS (PARTITION BY conv_id, kind)) WHERE n_obs > 0"""))
def mirror_test(spark, sf):
    wins, refs, _, terms = _linked(spark, sf)
    later = refs.join(wins.select("session_id", "seg_id", "birth"), ["session_id", "seg_id"]).where("k > birth").drop("birth")
    return bound.mirror_test(wins, later, terms).drop("p")


@query("segment_needs", t("SELECT conv_id AS session_id, seg_id, CAST(m AS BIGINT) AS m, last, resident, n0 AS need_P0, n1 AS need_P1000, n2 AS need_P10000, n3 AS need_Pinf FROM nd"))
def segment_needs(spark, sf):
    n, _, _ = _needs(spark, sf)
    return n.select("session_id", "seg_id", "m", "last", "resident", "need_P0", "need_P1000", "need_P10000", "need_Pinf")


@query("context_bound", t("""SELECT session_id, CAST(api_calls AS BIGINT) AS api_calls, CAST(measured AS BIGINT) AS measured_input, resident, round(100 * (resident - n0) / measured, 6) AS avoidable_pct_P0, round(100 * (resident - n1) / measured, 6) AS avoidable_pct_P1000,
  round(100 * (resident - n2) / measured, 6) AS avoidable_pct_P10000, round(100 * (resident - n3) / measured, 6) AS avoidable_pct_Pinf FROM bd WHERE measured > 0"""))
def context_bound(spark, sf):
    n, _, calls = _needs(spark, sf)
    b = bound.bound(n, calls).where("measured_input > 0")
    return b.select("session_id", "api_calls", "measured_input", "resident", *[F.round(f"avoidable_pct_{p}", 6).alias(f"avoidable_pct_{p}") for p in ("P0", "P1000", "P10000", "Pinf")])


@query("bound_policies", t("SELECT session_id, policy, need AS needed, measured - (resident - need) AS bound_input FROM (SELECT session_id, measured, resident, unnest(['P0', 'P1000', 'P10000', 'Pinf']) AS policy, unnest([n0, n1, n2, n3]) AS need FROM bd)"))
def bound_policies(spark, sf):
    n, _, calls = _needs(spark, sf)
    return bound.policy_rows(bound.bound(n, calls)).select("session_id", "policy", "needed", "bound_input")


@query("bound_by_kind", t("SELECT kind, CAST(count(*) AS BIGINT) AS segments, sum(tokens) AS tokens, sum(resident) AS resident, round(100 * (sum(resident) - sum(n3)) / sum(resident), 6) AS dead_after_last_use_pct, round(100 * (sum(resident) - sum(n0)) / sum(resident), 6) AS unneeded_pct FROM nd GROUP BY 1"))
def bound_by_kind(spark, sf):
    k = bound.by_kind(_needs(spark, sf)[0])
    return k.select("kind", "segments", "tokens", "resident", F.round("dead_after_last_use_pct", 6).alias("dead_after_last_use_pct"), F.round("unneeded_pct", 6).alias("unneeded_pct"))


@query("bound_merged", t("SELECT CAST(count(*) AS BIGINT) AS sessions, CAST(sum(measured) AS BIGINT) AS measured_input, sum(resident) AS resident, round(100 * (sum(resident) - sum(n0)) / sum(measured), 6) AS avoidable_pct_P0, round(100 * (sum(resident) - sum(n3)) / sum(measured), 6) AS avoidable_pct_Pinf FROM bd"))
def bound_merged(spark, sf):
    n, _, calls = _needs(spark, sf)
    m = bound.merge(bound.bound(n, calls).withColumn("method", F.lit(bound.METHOD)))
    return m.select("sessions", "measured_input", "resident", F.round("avoidable_pct_P0", 6).alias("avoidable_pct_P0"), F.round("avoidable_pct_Pinf", 6).alias("avoidable_pct_Pinf"))


@query("bound_export", t("SELECT api_calls::BIGINT AS api_calls, measured::BIGINT AS measured_input, round(100 * (measured - resident) / measured, 6) AS pinned_pct, round(100 * (resident - n0) / measured, 6) AS \"avoidable_pct_P0\" FROM (SELECT * FROM bd ORDER BY session_id LIMIT 200) WHERE measured > 0"))
def bound_export(spark, sf):
    n, _, calls = _needs(spark, sf)
    return bound.export(bound.bound(n, calls)).where("measured_input > 0").select("api_calls", "measured_input", F.round("pinned_pct", 6).alias("pinned_pct"), F.round("avoidable_pct_P0", 6).alias("avoidable_pct_P0"))


@query("bound_sensitivity", t("""SELECT session_id, CAST(ms AS BIGINT) AS min_shared, cf AS common_frac, round(100 * (resident - n0) / measured, 6) AS p0, round(100 * (resident - ni) / measured, 6) AS pinf FROM (
  SELECT s.conv_id AS session_id, ms, cf, any_value(measured) AS measured, sum(tokens * (e - birth)) AS resident, sum(tokens * CASE WHEN e > birth THEN 1 + coalesce(x.m, 0) ELSE 0 END) AS n0, sum(tokens * CASE WHEN e > birth THEN coalesce(x.l, birth) - birth + 1 ELSE 0 END) AS ni
  FROM sg s JOIN n USING (conv_id), (SELECT unnest([1, 2, 3]) AS ms) a, (SELECT unnest([0.01, 0.02, 0.05])::DOUBLE AS cf) b LEFT JOIN (SELECT conv_id AS c, seg_id AS g, ms AS ms2, cf AS cf2, count(*) AS m, max(k) AS l FROM sh, (SELECT unnest([1, 2, 3]) AS ms) a2, (SELECT unnest([0.01, 0.02, 0.05])::DOUBLE AS cf) b2
    WHERE CASE cf WHEN 0.01 THEN s0 WHEN 0.02 THEN s1 ELSE s2 END >= ms GROUP BY ALL) x ON x.c = s.conv_id AND x.g = s.seg_id AND x.ms2 = ms AND x.cf2 = cf GROUP BY 1, 2, 3) WHERE measured > 0"""))
def bound_sensitivity(spark, sf):
    segs, terms, calls = _trace(spark, sf)
    s = bound.sensitivity(segs, terms, calls)
    measured = calls.groupBy("session_id").agg(F.sum("context").alias("_m")).where("_m > 0").select("session_id")
    return s.join(measured, "session_id", "left_semi").select("session_id", "min_shared", "common_frac", F.round("avoidable_pct_P0", 6).alias("p0"), F.round("avoidable_pct_Pinf", 6).alias("pinf"))


@query("sensitivity_medians")
def sensitivity_medians(spark, sf):
    return policy.sensitivity_summary(bound.sensitivity(*_trace(spark, sf)))


# instruction starts of a chat: the call that answers each prompt
ST = f"""{TRACE},
st AS (SELECT DISTINCT conv_id, replies AS s FROM tr WHERE role = 'user'),
ca0 AS (SELECT nd.*, CASE WHEN kind = 'user_prompt' THEN birth ELSE birth - 1 END AS o FROM nd WHERE e > birth),
ca1 AS (SELECT *, greatest(coalesce((SELECT min(s) FROM st WHERE st.conv_id = ca0.conv_id AND s > o), e), birth) AS a FROM ca0),
ca AS (SELECT *, (SELECT count(*) FROM rf WHERE rf.conv_id = ca1.conv_id AND rf.seg_id = ca1.seg_id AND rf.k >= a) AS used FROM ca1 WHERE a < e)"""


def _starts(spark, sf):
    tr = tables.turns(spark, sf)
    tr = scale.scan(tr, ["conv_id"], ["idx"], replies=scale.running_sum((F.col("role") == "assistant").cast("bigint")))
    return tr.where("role = 'user'").select(F.col("conv_id").alias("session_id"), F.col("replies").alias("start_k")).distinct()


def _parts(spark, sf):
    n, refs, calls = _needs(spark, sf)
    return bound.carried_parts(n, refs, calls, _starts(spark, sf)), calls


@query("carried_from_finished", with_views(ST, "SELECT conv_id AS session_id, sum(tokens * (e - a)) AS carried, sum(tokens * greatest(0, e - greatest(a, last + 1))) AS dead, sum(tokens * (e - a - used)) AS idle FROM ca GROUP BY 1"))
def carried_from_finished(spark, sf):
    return bound.carried(_parts(spark, sf)[0])


@query("stale_context", with_views(ST, """SELECT session_id, instr, stale AS w5, CAST(ctx AS BIGINT) AS w5_input FROM (SELECT cl.conv_id AS session_id, i AS instr, sum(context) AS ctx, coalesce(sum((SELECT sum(tokens) FROM ca WHERE ca.conv_id = cl.conv_id AND greatest(a, last + 1) <= k AND k < e)), 0)::DOUBLE AS stale
  FROM cl JOIN (SELECT conv_id, replies - 1 AS k, u AS i FROM (SELECT *, count(*) FILTER (WHERE role = 'user') OVER (PARTITION BY conv_id ORDER BY idx) AS u FROM tr) WHERE role = 'assistant') USING (conv_id, k) WHERE i >= 1 GROUP BY 1, 2)"""))
def stale_context(spark, sf):
    parts, calls = _parts(spark, sf)
    tr = scale.scan(tables.turns(spark, sf), ["conv_id"], ["idx"], u=scale.running_sum((F.col("role") == "user").cast("bigint")), r=scale.running_sum((F.col("role") == "assistant").cast("bigint")))
    instr = tr.where("role = 'assistant'").select(F.col("conv_id").alias("session_id"), (F.col("r") - 1).alias("k"), F.col("u").alias("instr"))
    return rules.stale_context(parts, calls.join(instr, ["session_id", "k"]))


# ---------------------------------------------------------------- calibration on the event histories

from .registry import CALLS  # noqa: E402

# visible pieces: each call's tool result is born at the next call, at a third of the growth
CAL = f"""{CALLS},
sgc AS (SELECT session_id, k AS seg_id, growth / 3.0::DOUBLE AS tokens, k + 1 AS birth FROM calls WHERE growth > 0),
es AS (SELECT session_id, birth AS k, sum(tokens) AS est FROM sgc GROUP BY 1, 2),
cg AS (SELECT c.session_id, c.k, coalesce(est, 0) AS est, context, prev_ctx, prev_ctx IS NULL OR is_compact = 1 AS restart, first_value(context) OVER (PARTITION BY c.session_id ORDER BY c.k) AS c0 FROM calls c LEFT JOIN es USING (session_id, k)),
fc AS (SELECT session_id, CASE WHEN count(r) >= 5 THEN list_sort(list(r) FILTER (WHERE r IS NOT NULL))[count(r) // 2 + 1] ELSE 1.0 END AS factor FROM (SELECT session_id, CASE WHEN NOT restart AND est >= 2000 AND context > prev_ctx THEN (context - prev_ctx) / est END AS r FROM cg) GROUP BY 1),
sc AS (SELECT *, CASE WHEN k = 0 THEN 0 ELSE context - CASE WHEN restart THEN c0 ELSE prev_ctx END END AS grown FROM cg JOIN fc USING (session_id)),
sd AS (SELECT *, CASE WHEN k = 0 THEN 0.0 WHEN est > 0 AND grown > 0 THEN least(factor, grown / est) ELSE factor END AS sc FROM sc)"""


def _calibrated(spark, sf):
    calls = tables.calls(spark, sf)
    segs = calls.where("growth > 0").select("session_id", F.col("k").alias("seg_id"), F.lit("tool_result").alias("kind"), (F.col("growth") / 3.0).alias("tokens"), (F.col("k") + 1).alias("birth"), F.array().cast("array<string>").alias("terms"))
    return bound.calibrate(segs, calls, order=["ts", "event_id"])


@query("tokenizer_factors", with_views(CAL, "SELECT session_id, round(factor, 6)::DOUBLE AS factor FROM fc"))
def tokenizer_factors(spark, sf):
    return _calibrated(spark, sf)[1].select("session_id", F.round("factor", 6).alias("factor"))


@query("calibrated_context", with_views(CAL, """SELECT session_id, kind, round(sum(tokens), 3) AS tokens FROM (SELECT s.session_id, 'tool_result' AS kind, s.tokens * coalesce(sd.sc, 1) AS tokens FROM sgc s LEFT JOIN sd ON sd.session_id = s.session_id AND sd.k = s.birth
  UNION ALL SELECT session_id, 'unattributed', grown - est * sc FROM sd WHERE grown - est * sc <> 0) GROUP BY 1, 2"""))
def calibrated_context(spark, sf):
    segs, _ = _calibrated(spark, sf)
    return segs.groupBy("session_id", "kind").agg(F.round(F.sum("tokens"), 3).alias("tokens"))


# ---------------------------------------------------------------- policies

POL = f"""{TRACE},
gr AS (SELECT unnest([1, 2, 4, 8, 16, 32])::BIGINT AS nn),
base AS (SELECT n.conv_id, measured, measured - coalesce(sum(resident) FILTER (WHERE e > birth), 0) AS b, coalesce(sum(tokens) FILTER (WHERE e > birth), 0) AS born FROM n LEFT JOIN nd USING (conv_id) GROUP BY 1, 2),
gq AS (SELECT conv_id, nn, count(*) AS refs, sum(tokens) AS used, sum(tokens * least(gap - 1, nn)) AS rk, count(*) FILTER (WHERE gap > nn) AS rm, sum((gap - 1 - least(gap - 1, nn)) * least(20.0, tokens)) AS rs, count(*) FILTER (WHERE k - birth >= nn) AS wm, coalesce(sum(tokens) FILTER (WHERE k - birth >= nn), 0) AS wn
  FROM gp, gr WHERE gap IS NOT NULL GROUP BY 1, 2),
sq AS (SELECT conv_id, nn, sum(tokens * least(e - birth, nn)) AS wk, sum(tokens * least(e - 1 - last, nn)) AS tk, sum((e - 1 - last - least(e - 1 - last, nn)) * least(20.0, tokens)) AS ts FROM nd, gr WHERE e > birth GROUP BY 1, 2),
po AS (SELECT conv_id AS session_id, measured, nn, coalesce(refs, 0) AS refs, b + coalesce(wk, 0) + coalesce(wn, 0) + 1000.0 * coalesce(wm, 0) AS c_window, coalesce(wm, 0) AS m_window,
  b + born + coalesce(used, 0) + coalesce(rk, 0) + 1000.0 * coalesce(rm, 0) + coalesce(tk, 0) AS c_recency, coalesce(rm, 0) AS m_recency, b + born + coalesce(used, 0) + coalesce(rk, 0) + 1000.0 * coalesce(rm, 0) + coalesce(tk, 0) + coalesce(rs, 0) + coalesce(ts, 0) AS c_pointer
  FROM base CROSS JOIN gr LEFT JOIN gq USING (conv_id, nn) LEFT JOIN sq USING (conv_id, nn)),
pl AS (SELECT session_id, measured, nn AS n, refs, unnest(['window', 'recency', 'pointer']) AS family, unnest([c_window, c_recency, c_pointer]) AS cost, unnest([m_window, m_recency, m_recency]) AS misses FROM po)"""


def _policies(spark, sf):
    n, refs, calls = _needs(spark, sf)
    return policy.simulate(n, refs, calls), n, calls


@query("policy_replay", with_views(POL, "SELECT session_id, family, n, cost::DOUBLE AS cost, CAST(refs AS BIGINT) AS refs, CAST(misses AS BIGINT) AS misses FROM pl"))
def policy_replay(spark, sf):
    return _policies(spark, sf)[0].select("session_id", "family", "n", "cost", "refs", "misses")


@query("full_policy", t("SELECT session_id, CAST(measured AS BIGINT) AS measured, CAST(r AS BIGINT) AS refs, measured::DOUBLE AS cost FROM bd JOIN (SELECT conv_id AS session_id, coalesce(sum(greatest(0, coalesce(m, 0) - 1)), 0) AS r FROM nd GROUP BY 1) USING (session_id)"))
def full_policy(spark, sf):
    n, _, calls = _needs(spark, sf)
    return policy.full_policy(n, calls)


ROWS = f"""{POL},
bt AS (SELECT pl.session_id, family, n, CASE WHEN pl.measured > 0 THEN 100 * (pl.measured - cost) / pl.measured ELSE 0 END AS saved, CASE WHEN refs > 0 THEN 100.0::DOUBLE * misses / refs ELSE 0 END AS miss, CASE WHEN bd.measured > 0 THEN 100 * (resident - n1) / bd.measured ELSE 0 END AS oracle, api_calls,
  CASE WHEN api_calls BETWEEN 3 AND 9 THEN '3-9' WHEN api_calls BETWEEN 10 AND 49 THEN '10-49' WHEN api_calls BETWEEN 50 AND 199 THEN '50-199' WHEN api_calls >= 200 THEN '200+' ELSE 'excluded' END AS bucket,
  CASE WHEN CAST('0x' || substr(sha256('c' || pl.session_id), 1, 2) AS INT) < 51 THEN 'dev' ELSE 'test' END AS split, CASE WHEN pl.session_id % 2 = 0 THEN 'even' ELSE 'odd' END AS source FROM pl JOIN bd USING (session_id) WHERE api_calls >= 3)"""


def _fingerprints(calls):
    return calls.select("session_id").distinct().select("session_id", F.concat(F.lit("c"), F.col("session_id").cast("string")).alias("fingerprint"), F.when(F.col("session_id") % 2 == 0, "even").otherwise("odd").alias("source"))


def _rows(spark, sf):
    p, n, calls = _policies(spark, sf)
    return policy.backtest_rows(p, bound.bound(n, calls), _fingerprints(calls))


@query("backtest_rows", with_views(ROWS, "SELECT session_id, family, n, round(saved, 6)::DOUBLE AS saved_pct, round(miss, 6) AS miss_rate, CASE WHEN oracle > 0 THEN round(100 * saved / oracle, 4) END::DOUBLE AS gap_closed_pct, bucket, split FROM bt"))
def backtest_rows(spark, sf):
    r = _rows(spark, sf)
    return r.select("session_id", "family", "n", F.round("saved_pct", 6).alias("saved_pct"), F.round("miss_rate", 6).alias("miss_rate"), F.round("gap_closed_pct", 4).alias("gap_closed_pct"), "bucket", "split")


@query("excluded_sessions", t("SELECT CAST(count(*) AS BIGINT) AS loaded, CAST(count(*) FILTER (WHERE n_calls < 3) AS BIGINT) AS excluded_short, CAST(count(*) FILTER (WHERE n_calls >= 3) AS BIGINT) AS kept FROM n"))
def excluded_sessions(spark, sf):
    return policy.exclusions(_trace(spark, sf)[2])


@query("tuned_policies", with_views(ROWS, """SELECT family, CAST(ds AS BIGINT) AS dev_sessions, CASE WHEN ds < 5 THEN 8 ELSE coalesce((SELECT arg_max(n, s * 1000000 - n) FROM (SELECT n, quantile_cont(saved, 0.5)::DOUBLE AS s, quantile_cont(miss, 0.5) AS mm FROM bt x WHERE x.family = f.family AND split = 'dev' GROUP BY n) WHERE mm <= 5), 32) END::BIGINT AS n
  FROM (SELECT family, count(DISTINCT session_id) FILTER (WHERE split = 'dev') AS ds FROM bt GROUP BY 1) f"""))
def tuned_policies(spark, sf):
    return policy.tune(_rows(spark, sf))


@query("policy_strata", with_views(ROWS, """SELECT stratum, label, CAST(count(*) AS BIGINT) AS sessions, round(quantile_cont(saved, 0.25), 6)::DOUBLE AS q1, round(quantile_cont(saved, 0.5), 6)::DOUBLE AS median, round(quantile_cont(saved, 0.75), 6)::DOUBLE AS q3, count(*) < 10 AS insufficient FROM (
  SELECT saved::DOUBLE AS saved, unnest(['all', 'test', 'source', 'length', 'source_length']) AS stratum, unnest(['all', CASE WHEN split = 'test' THEN 'test' END, source, bucket, source || '|' || bucket]) AS label FROM bt WHERE family = 'recency' AND n = 2) WHERE label IS NOT NULL GROUP BY 1, 2"""))
def policy_strata(spark, sf):
    r = _rows(spark, sf).where("family = 'recency' AND n = 2")
    s = policy.strata(r, "saved_pct")
    return s.select("stratum", "label", "sessions", *[F.round(c, 6).alias(c) for c in ("q1", "median", "q3")], "insufficient")


@query("bootstrap_medians")
def bootstrap_medians(spark, sf):
    r = _rows(spark, sf).where("n = 2")
    return policy.bootstrap_median(r, ["family"], "saved_pct", reps=2000)


@query("validation_pairs")
def validation_pairs(spark, sf):
    wins, refs, calls, _ = _linked(spark, sf)
    return policy.validation_pairs(wins, refs, _fingerprints(calls), 60).select("session_id", "seg_id", "k", "stratum", "key")


QUAL = f"""{TRACE},
an AS (SELECT CASE WHEN k > birth THEN 'hit' ELSE 'miss' END AS stratum, k % 3 <> 0 AS needed FROM gp)"""


@query("detector_quality", with_views(QUAL, """SELECT CAST(dh AS BIGINT) AS detected, CAST(dm AS BIGINT) AS not_detected, round(100.0::DOUBLE * h / dh, 6) AS precision_p, round(100.0::DOUBLE * m / dm, 6) AS missed_p, round(100 * (h::DOUBLE / dh * dh) / (h::DOUBLE / dh * dh + m::DOUBLE / dm * dm), 6) AS recall_estimate
  FROM (SELECT count(*) FILTER (WHERE stratum = 'hit') AS dh, count(*) FILTER (WHERE stratum = 'miss') AS dm, count(*) FILTER (WHERE stratum = 'hit' AND needed) AS h, count(*) FILTER (WHERE stratum = 'miss' AND needed) AS m FROM an)"""))
def detector_quality(spark, sf):
    """Links after birth stand for detected pairs, births for undetected ones; the answer follows the call number."""
    _, refs, _, _ = _linked(spark, sf)
    g = bound.with_gaps(refs)
    a = g.select(F.when(F.col("gap").isNotNull(), "hit").otherwise("miss").alias("stratum"), (F.col("k") % 3 != 0).alias("needed"))
    pop = a.groupBy("stratum").agg(F.count(F.lit(1)).alias("size"))
    q = policy.detector_quality(a, pop)
    return q.select("detected", "not_detected", *[F.round(c, 6).alias(c) for c in ("precision_p", "missed_p", "recall_estimate")])


@query("session_manifest", """WITH f AS (SELECT DISTINCT 'c' || conv_id AS f FROM conversations WHERE role IN ('user', 'assistant')),
p AS (SELECT substr(sha256(f), 1, 4) AS p, sha256(string_agg(f, chr(10) ORDER BY f)) AS d, count(*) AS n FROM f GROUP BY 1)
SELECT sha256(string_agg(d, chr(10) ORDER BY d)) AS digest, CAST(sum(n) AS BIGINT) AS sessions FROM p""")
def session_manifest(spark, sf):
    ids = tables.turns(spark, sf).select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("fingerprint")).distinct()
    return policy.manifest_digest(ids)
