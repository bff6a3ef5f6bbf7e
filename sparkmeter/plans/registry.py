"""Registry of queries over the star-schema tables, each with an equivalent DuckDB query where SQL can say it."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(name)
        QUERIES[name] = _prepared(fn)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def _prepared(fn):
    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return fn(spark, sf_dir)

    return run


def load_all() -> None:
    from . import bound_queries, call_queries, chat_queries, log_queries, memo_queries, record_queries, text_queries  # noqa: F401


# ---------------------------------------------------------------- shared views, DuckDB side

SPACE = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
CJK = "[ᄀ-ᇿ぀-ヿ㄰-㆏㐀-鿿가-힯豈-﫿]"
W = r"[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]"
NW = r"[^\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]"


def tokens_sql(text: str) -> str:
    rest = f"regexp_replace({text}, '{CJK}', '', 'g')"
    return (f"(CASE WHEN {text} IS NULL OR {text} = '' THEN 0 ELSE greatest(1, CAST(ceil(length({text}) - length({rest}) + "
            f"length(trim(regexp_replace({rest}, '{SPACE}+', ' ', 'g'))) / 4.0) AS BIGINT)) END)")


TURNS = f"""turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx, role, text,
  {tokens_sql('text')} AS tokens
  FROM conversations WHERE role IN ('user', 'assistant') AND length(trim(text)) > 0)"""

MARKED = f"""{TURNS},
firsts AS (SELECT conv_id, text AS first_text FROM turns WHERE idx = 0),
marked0 AS (SELECT t.conv_id, t.idx, t.role, CASE WHEN role = 'user' THEN CASE (t.conv_id + t.idx) % 9
    WHEN 0 THEN 'Thanks!' WHEN 1 THEN 'continue' WHEN 2 THEN 'No, that''s wrong. ' || text WHEN 3 THEN 'Also ' || text
    WHEN 4 THEN text || '?' WHEN 5 THEN '```py' || chr(10) || text || chr(10) || '```' WHEN 6 THEN first_text ELSE text END
  ELSE CASE (t.conv_id + t.idx) % 9 WHEN 0 THEN 'Sorry, ' || text WHEN 1 THEN 'I cannot do that. ' || substr(text, 1, 80)
    WHEN 2 THEN 'Which one do you mean?' WHEN 3 THEN '```py' || chr(10) || 'x = 1' || chr(10) || '``` ' || text ELSE text END END AS text
  FROM turns t JOIN firsts f USING (conv_id)),
marked AS (SELECT *, {tokens_sql('text')} AS tokens, contains(text, '```') AS has_code FROM marked0)"""

CALLS = """calls_e AS (SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k, ts, event_id, event_type,
    props AS input_sig, CAST(floor(value * 100) AS BIGINT) AS growth, CAST(floor(value / 10) AS BIGINT) AS result_hash,
    CASE event_type WHEN 'view' THEN 'Read' WHEN 'click' THEN 'Write' WHEN 'purchase' THEN 'mcp__shop__buy' WHEN 'error' THEN 'Bash' ELSE 'Grep' END AS name,
    (event_type = 'error' OR event_id % 13 = 0) AS is_error, CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS is_instr,
    CASE WHEN event_id % 50 = 0 THEN 1 ELSE 0 END AS is_compact, CAST(floor(value) AS BIGINT) AS output,
    CASE WHEN event_id % 40 = 0 THEN 'b' ELSE 'a' END AS model, event_id % 7 = 0 AS is_side FROM events),
calls_f AS (SELECT *, CAST(sum(is_compact) OVER w AS BIGINT) AS epoch, CAST(sum(is_instr) OVER w AS BIGINT) AS instr FROM calls_e WINDOW w AS (PARTITION BY session_id ORDER BY k)),
calls_g AS (SELECT *, CAST(5000 + sum(growth) OVER (PARTITION BY session_id, epoch ORDER BY k) AS BIGINT) AS context FROM calls_f),
calls_h AS (SELECT *, lag(context) OVER w AS prev_ctx, lag(ts) OVER w AS prev_ts, lag(model) OVER w AS prev_model FROM calls_g WINDOW w AS (PARTITION BY session_id ORDER BY k)),
calls_i AS (SELECT *, CASE WHEN prev_ctx IS NULL OR context < prev_ctx THEN 0 WHEN ts - prev_ts < INTERVAL '1' HOUR THEN prev_ctx ELSE 0 END AS cache_read FROM calls_h),
calls AS (SELECT *, context - cache_read AS cache_write, CASE WHEN event_id % 3 = 0 THEN context - cache_read ELSE 0 END AS cache_write_1h FROM calls_i),
tools AS (SELECT session_id, k, ts, event_id, name, input_sig, epoch, instr, context, result_hash, event_id % 17 <> 0 AS has_result,
    CASE WHEN name IN ('Read', 'Write') THEN '/p/' || regexp_extract(input_sig, '([0-9]+)', 1) END AS path,
    CASE WHEN event_id % 17 <> 0 THEN growth ELSE 0 END AS result_tokens, is_error AND event_id % 17 <> 0 AS is_error,
    event_id % 5 = 0 AS has_text, CASE WHEN event_id % 19 = 0 THEN 1 ELSE 0 END AS images FROM calls),
ends AS (SELECT session_id, epoch, max(k) + 1 AS epoch_end FROM calls GROUP BY ALL)"""


def with_views(views: str, body: str) -> str:
    return f"WITH {views},\n{body}" if not body.lstrip().upper().startswith("SELECT") else f"WITH {views}\n{body}"
