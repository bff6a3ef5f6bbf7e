"""Column functions over documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import intent as it
from ..functions import numbers as num
from ..functions import text as tx
from ..sources import tables
from .registry import MARKED, NW, SPACE, TURNS, query, tokens_sql, with_views


@query("token_estimates", f"SELECT doc_id, {tokens_sql('text')} AS tokens FROM documents")
def token_estimates(spark, sf):
    return tables.load(spark, sf, "documents").select("doc_id", tx.estimate_tokens("text").alias("tokens"))


def _sub(text: str, *patterns: str) -> str:
    for p in patterns:
        text = f"regexp_replace({text}, '{p}', ' ', 'g')"
    return text


PII_SQL = (
    r"[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}.+-]+@[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}-]+\.[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}.-]+",
    r"https?://\S+|www\.\S+", r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b", r"\b(?:sk|pk|ghp|gho|xox[abp]|AKIA)[-_A-Za-z0-9]{12,}\b",
    r"\b[A-Za-z0-9_\-]{32,}\b", r"\+?[0-9][0-9\s\-().]{7,}[0-9]")


@query("pii_scrubbed", f"SELECT doc_id, md5({_sub('text', *PII_SQL)}) AS digest, CAST(length({_sub('text', *PII_SQL)}) AS BIGINT) AS n FROM documents")
def pii_scrubbed(spark, sf):
    clean = tx.scrub_pii("text")
    return tables.load(spark, sf, "documents").select("doc_id", F.md5(clean).alias("digest"), F.length(clean).cast("bigint").alias("n"))


@query("code_fences", with_views(MARKED, r"""SELECT conv_id, idx, md5(regexp_replace(text, '(?s)```[^\n]*\n.*?(?:```|$)', ' ', 'g')) AS digest,
  regexp_matches(text, '(?s)```[^\n]*\n.*?(?:```|$)') AS has_code FROM marked"""))
def code_fences(spark, sf):
    return tables.marked_turns(spark, sf).select("conv_id", "idx", F.md5(tx.prose("text")).alias("digest"), tx.has_code("text").alias("has_code"))


def words_sql(text: str) -> str:
    """Latin part of the content words, as a list."""
    stop = ", ".join("'" + w + "'" for w in tx.STOP_EN)
    short = ", ".join("'" + w + "'" for w in tx.SHORT_WORDS)
    prose = _sub(f"regexp_replace({text}, '(?s)```[^\\n]*\\n.*?(?:```|$)', ' ', 'g')", *PII_SQL)
    found = f"regexp_extract_all({prose}, '[A-Za-z][A-Za-z0-9+#]*(?:[.\\-][A-Za-z0-9+#]+)*')"
    low = f"list_transform({found}, lambda w: lower(trim(w, '.-')))"
    return f"list_filter({low}, lambda w: (length(w) >= 3 OR w IN ({short})) AND w NOT IN ({stop}))"


@query("content_words", f"""WITH w AS (SELECT doc_id, unnest({words_sql('text')}) AS word FROM documents)
SELECT word, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT doc_id) AS BIGINT) AS docs FROM w GROUP BY word""")
def content_words(spark, sf):
    w = tables.load(spark, sf, "documents").select("doc_id", F.explode(tx.content_words("text")).alias("word"))
    per = w.groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("word").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs"))


_LATIN, _HANGUL = "abcdefghijklmnopqrstuvwxyz", "갑낭닥락막박삭악작착칵탁팍학곡녹독록목복속옥족촉콕톡"


@query("korean_stems", f"""WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{{4,}}')) AS w FROM documents)
SELECT translate(w, '{_LATIN}', '{_HANGUL}') AS stem, CAST(count(*) AS BIGINT) AS n FROM w GROUP BY 1""")
def korean_stems(spark, sf):
    """The table's words spelled in Hangul with a particle attached; stripping gives the stems back."""
    w = tables.load(spark, sf, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))).alias("w"))
    hangul = F.concat(F.translate("w", _LATIN, _HANGUL), F.lit("에서는"))
    return w.groupBy(tx._strip_suffix(hangul).alias("stem")).agg(F.count(F.lit(1)).alias("n"))


@query("languages", """WITH c AS (SELECT doc_id, 2.0 * length(regexp_replace(text, '[^가-힣]', '', 'g')) AS ko, 2.0 * length(regexp_replace(text, '[^぀-ヿ]', '', 'g')) AS ja,
  2.0 * length(regexp_replace(text, '[^一-鿿]', '', 'g')) AS zh, 0.5 * length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS en FROM documents)
SELECT doc_id, CASE WHEN greatest(ko, ja, zh, en) <= 0 THEN 'und' WHEN ko = greatest(ko, ja, zh, en) THEN 'ko' WHEN ja = greatest(ko, ja, zh, en) THEN 'ja'
  WHEN zh = greatest(ko, ja, zh, en) THEN 'zh' ELSE 'en' END AS detected FROM c""")
def languages(spark, sf):
    return tables.load(spark, sf, "documents").select("doc_id", tx.detect_language("text").alias("detected"))


@query("fnv_hashes", """WITH RECURSIVE d AS (SELECT DISTINCT source AS s FROM documents),
b AS (SELECT s, unnest(range(1, length(hex(encode(s))) // 2 + 1)) AS i FROM d),
f AS (SELECT s, 0 AS i, 2166136261::BIGINT AS h FROM d UNION ALL
  SELECT f.s, f.i + 1, ((xor(f.h, CAST('0x' || substr(hex(encode(f.s)), 2 * f.i + 1, 2) AS BIGINT)) * 16777619::HUGEINT) % 4294967296)::BIGINT FROM f WHERE f.i < length(hex(encode(f.s))) // 2)
SELECT s AS source, h AS hash FROM f WHERE i = length(hex(encode(s))) // 2""")
def fnv_hashes(spark, sf):
    d = tables.load(spark, sf, "documents").select("source").distinct()
    return d.select("source", tx.fnv1a32("source").alias("hash"))


@query("simhash_fingerprints")
def simhash_fingerprints(spark, sf):
    d = tables.load(spark, sf, "documents")
    return d.select("doc_id", tx.simhash64(tx.content_words("text"), tx.fallback_tokens("text"), b"salt").alias("fp"))


@query("bit_similarity", """WITH h AS (SELECT e.event_id, e.event_id * 2654435761 AS a, lag(e.event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) * 2654435761 AS b FROM events e)
SELECT event_id, CASE WHEN a = 0 OR b = 0 THEN 0.0 ELSE 1 - bit_count(xor(a, b)) / 64.0 END::DOUBLE AS similarity FROM h WHERE b IS NOT NULL""")
def bit_similarity(spark, sf):
    from ..scale import previous, scan, with_blocks

    e = with_blocks(tables.load(spark, sf, "events").select("event_id", "user_id", "ts"), ["user_id"], "ts")
    h = scan(e, ["user_id"], ["ts", "event_id"], p=previous(F.col("event_id"))).where("p IS NOT NULL")
    return h.select("event_id", tx.simhash_similarity(F.col("event_id") * 2654435761, F.col("p") * 2654435761).alias("similarity"))


@query("prompt_reply_overlap", with_views(TURNS, f"""w AS (SELECT conv_id, idx, role, list_distinct({words_sql('text')}) AS ws FROM turns),
p AS (SELECT conv_id, idx, role, ws, lag(ws) OVER (PARTITION BY conv_id ORDER BY idx) AS q FROM w)
SELECT conv_id, idx, CASE WHEN len(ws) = 0 OR len(q) = 0 THEN 0.0 ELSE len(list_intersect(ws, q))::DOUBLE / (len(ws) + len(q) - len(list_intersect(ws, q))) END AS overlap
FROM p WHERE q IS NOT NULL"""))
def prompt_reply_overlap(spark, sf):
    from ..scale import previous, scan

    t = tables.turns(spark, sf).withColumn("ws", F.array_distinct(tx.content_words("text")))
    t = scan(t, ["conv_id"], ["idx"], q=previous(F.col("ws"))).where("q IS NOT NULL")
    return t.select("conv_id", "idx", tx.jaccard("ws", "q").alias("overlap"))


@query("distinctive_terms", r"""WITH t AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_./\-]{5,}|[가-힣]{3,}|[0-9]{4,}'))) AS term FROM documents)
SELECT term, CAST(count(*) AS BIGINT) AS docs FROM t GROUP BY term""")
def distinctive_terms(spark, sf):
    t = tables.load(spark, sf, "documents").select(F.explode(tx.distinctive_terms("text")).alias("term"))
    return t.groupBy("term").agg(F.count(F.lit(1)).alias("docs"))


def _rx(text: str, *patterns: str) -> str:
    return f"regexp_matches({text}, '(?i)" + "|".join(p.replace("'", "''") for p in patterns) + "')"


_H = f"^{NW}*"
_E = f"(?:{NW}|$)"
ACK_SQL = f"{_H}(thanks?( you)?|thx|ty|ok(ay)?|cool|great|nice|perfect|awesome|got it|good|lol|haha){NW}*$"
CONT_SQL = f"{_H}(continue|go on|keep going|more|next|and\\??|proceed){NW}*$"
CORRECT_SQL = (f"{_H}no{_E}", f"(?:^|{NW})that'?s (not|wrong){_E}", f"(?:^|{NW})(wrong|incorrect|doesn'?t work|not working|still (not|broken|wrong)|didn'?t work){_E}",
               f"(?:^|{NW})not what i{_E}", f"(?:^|{NW})try again{_E}", f"(?:^|{NW})you (missed|forgot|ignored){_E}", f"(?:^|{NW})i said{_E}", f"(?:^|{NW})still (getting|the same){_E}")
CLARIFY_SQL = (f"{_H}(also|and also|but|however|additionally|actually|only|make it|instead|what if){_E}", f"(?:^|{NW})(in addition|one more thing|more specifically){_E}")
ASK_SQL = (r"\?\s*$", f"{_H}(what|why|how|when|where|which|who|is|are|can|could|should|does|do){_E}")
SORRY_SQL = f"{_H}(you'?re (absolutely )?right|my apologies|apologies|i apologi[sz]e|sorry)"
REFUSE_SQL = f"{_H}(i can'?t|i cannot|i'?m (not able|unable)|i won'?t)"
_T = f"regexp_replace(text, '^{SPACE}+|{SPACE}+$', '', 'g')"
_ASKS = f"({_rx('right(' + _T + ', 200)', *ASK_SQL)} OR {_rx('substr(' + _T + ', 1, 80)', *ASK_SQL)})"
# similar: the rule's input, here the re-asked first prompt
INTENT_SQL = f"""CASE WHEN role = 'user' THEN CASE
  WHEN is_first THEN CASE WHEN tokens >= 600 OR (has_code AND tokens >= 250) THEN 'context' WHEN {_ASKS} THEN 'ask' ELSE 'instruct' END
  WHEN is_similar AND tokens > 3 THEN 'retry' WHEN tokens <= 12 AND {_rx(_T, ACK_SQL)} THEN 'ack' WHEN tokens <= 12 AND {_rx(_T, CONT_SQL)} THEN 'continue'
  WHEN tokens >= 600 OR (has_code AND tokens >= 250) THEN 'context' WHEN {_rx('substr(' + _T + ', 1, 240)', *CORRECT_SQL)} THEN 'correct'
  WHEN {_rx('substr(' + _T + ', 1, 120)', *CLARIFY_SQL)} THEN 'clarify' WHEN {_ASKS} THEN 'ask' ELSE 'instruct' END
ELSE CASE WHEN {_rx('substr(' + _T + ', 1, 200)', SORRY_SQL)} THEN 'apology_fix' WHEN {_rx('substr(' + _T + ', 1, 200)', REFUSE_SQL)} AND tokens < 300 THEN 'refusal'
  WHEN tokens < 120 AND {_T} LIKE '%?' THEN 'followup_question' WHEN has_code THEN 'code' ELSE 'answer' END END"""
NODES = f"""{MARKED},
nodes0 AS (SELECT *, role = 'user' AND row_number() OVER (PARTITION BY conv_id, role ORDER BY idx) = 1 AS is_first, role = 'user' AND (conv_id + idx) % 9 = 6 AS is_similar FROM marked),
nodes AS (SELECT *, {INTENT_SQL} AS intent, idx // 4 AS branch, idx % 3 AS depth FROM nodes0)"""


def nodes(spark, sf):
    """Marked turns with intents; thread and depth follow the position, to test accounting on its own."""
    from ..scale import running_sum, scan

    t = tables.marked_turns(spark, sf).withColumn("has_code", F.col("text").contains("```"))
    t = scan(t, ["conv_id"], ["idx"], u=running_sum((F.col("role") == "user").cast("bigint")))
    user = F.col("role") == "user"
    similar = F.pmod(F.col("conv_id") + F.col("idx"), F.lit(9)) == 6
    ui = it.user_intent("text", "tokens", similar, "has_code", F.col("u") == 1)
    return t.withColumns({"intent": F.when(user, ui).otherwise(it.reply_intent("text", "tokens", "has_code")),
                          "branch": F.floor(F.col("idx") / 4), "depth": F.col("idx") % 3}).drop("u")


@query("turn_intents", with_views(NODES, "SELECT conv_id, idx, role, intent FROM nodes"))
def turn_intents(spark, sf):
    return nodes(spark, sf).select("conv_id", "idx", "role", "intent")


@query("gratitude_turns", with_views(MARKED, f"""SELECT conv_id, idx FROM marked WHERE tokens <= 12 AND {_rx(_T,
  _H + '(thanks?( a lot| so much| you( so much| very much)?)?|thx|ty|many thanks|cheers|much appreciated|merci( beaucoup)?|gracias|danke( schön)?|obrigad[oa])[' + chr(92) + 's!.~♡❤️😊🙏👍]*$')}"""))
def gratitude_turns(spark, sf):
    return tables.marked_turns(spark, sf).where(it.is_gratitude("text")).select("conv_id", "idx")


@query("read_only_commands", r"""WITH c AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'cd /src && grep -n x ' WHEN 1 THEN 'git log --oneline ' WHEN 2 THEN 'git push ' WHEN 3 THEN '  ls ' ELSE 'catalog ' END || source AS command FROM documents)
SELECT doc_id, regexp_matches(command, '^\s*(?:cd\s+\S+\s*(?:&&|;)\s*)?(?:cat|head|tail|less|sed\s+-n|grep|egrep|rg|ag|find|ls|tree|wc|jq|git\s+(?:log|show|diff|status|grep|ls-files|blame))\b') AS reads FROM c""")
def read_only_commands(spark, sf):
    n = F.col("doc_id") % 5
    verb = F.when(n == 0, "cd /src && grep -n x ").when(n == 1, "git log --oneline ").when(n == 2, "git push ").when(n == 3, "  ls ").otherwise("catalog ")
    return tables.load(spark, sf, "documents").select("doc_id", it.is_read_command(F.concat(verb, "source")).alias("reads"))


@query("redacted_documents", "SELECT doc_id, md5(regexp_replace(regexp_replace(text, '[0-9]{2,}', '[가림]', 'g'), '(?i)the[a-z]*', '[가림]', 'g')) AS digest FROM documents")
def redacted_documents(spark, sf):
    return tables.load(spark, sf, "documents").select("doc_id", F.md5(tx.redact("text", ["[0-9]{2,}", "(?i)the[a-z]*", " "])).alias("digest"))


@query("label_hygiene", r"""WITH w AS (SELECT DISTINCT unnest(regexp_split_to_array(text, ' ')) AS w FROM documents)
SELECT CAST(count(*) FILTER (WHERE regexp_full_match(w, '[\p{L}\p{N}][\p{L}\p{N}+#.\-]{1,31}')) AS BIGINT) AS ok, CAST(count(*) AS BIGINT) AS n FROM w""")
def label_hygiene(spark, sf):
    w = tables.load(spark, sf, "documents").select(F.explode(F.split("text", " ")).alias("w")).distinct()
    return w.agg(F.count(F.when(num.label_ok("w"), 1)).alias("ok"), F.count(F.lit(1)).alias("n"))


@query("provider_enum", """WITH s AS (SELECT page_id, lower(url) || CASE page_id % 4 WHEN 0 THEN 'chatgpt' WHEN 1 THEN 'openai' WHEN 2 THEN 'x.com' ELSE '' END AS s FROM pages)
SELECT page_id, CASE WHEN contains(s, 'chatgpt') THEN 'chatgpt' WHEN contains(s, 'claude') THEN 'claude' WHEN contains(s, 'gemini') THEN 'gemini' WHEN contains(s, 'copilot') THEN 'copilot' WHEN contains(s, 'grok') THEN 'grok'
  WHEN contains(s, 'perplexity') THEN 'perplexity' WHEN contains(s, 'deepseek') THEN 'deepseek' WHEN contains(s, 'openai') THEN 'chatgpt' WHEN contains(s, 'x.com') THEN 'grok' ELSE 'other' END AS source FROM s""")
def provider_enum(spark, sf):
    n = F.col("page_id") % 4
    s = F.concat("url", F.when(n == 0, "ChatGPT").when(n == 1, "OpenAI").when(n == 2, "x.com").otherwise(""))
    return tables.load(spark, sf, "pages").select("page_id", num.source_enum(s).alias("source"))


@query("parsed_times", """SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE epoch_us(ts) END AS us FROM events""")
def parsed_times(spark, sf):
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    raw = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("not a time "), iso)).otherwise(iso)
    return tables.load(spark, sf, "events").select("event_id", F.unix_micros(tx.parse_time(raw)).alias("us"))


@query("epoch_days", "SELECT CAST(ts AS DATE) AS day, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL")
def epoch_days(spark, sf):
    e = tables.load(spark, sf, "events").select((F.unix_micros("ts") / 1e6).alias("at"))
    return e.groupBy(num.epoch_day("at").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("footprints", f"""SELECT doc_id, round(n_chars * {num.WH_PER_TOKEN!r}, 9) AS wh, round(n_chars * {num.WH_PER_TOKEN!r} / 1000 * 445.0, 9) AS g_co2,
  round(n_chars * {num.WH_PER_TOKEN_UPPER!r} / 19.0, 9) AS phone_charges_upper, round(n_chars * {num.WH_PER_TOKEN!r} / 1000 * 445.0 / {num.G_CO2_PER_G_WOOD!r}, 9) AS twig_g FROM documents""")
def footprints(spark, sf):
    low, high = num.footprint("n_chars"), num.footprint("n_chars", num.WH_PER_TOKEN_UPPER)
    d = tables.load(spark, sf, "documents")
    return d.select("doc_id", *[F.round(c, 9).alias(n) for c, n in ((low["wh"], "wh"), (low["g_co2"], "g_co2"), (high["phone_charges"], "phone_charges_upper"), (low["twig_g"], "twig_g"))])


@query("optimal_ceilings", "SELECT doc_id, round(64000.0 + sqrt(2.0 * n_chars * (64000.0 + 5000.0)), 6) AS ceiling FROM documents")
def optimal_ceilings(spark, sf):
    c = num.optimal_ceiling(F.lit(64000.0), F.col("n_chars").cast("double"), F.lit(5000.0))
    return tables.load(spark, sf, "documents").select("doc_id", F.round(c, 6).alias("ceiling"))


@query("compute_units", with_views(TURNS, "SELECT conv_id, sum(CASE WHEN role = 'user' THEN tokens * 0.25 ELSE tokens END)::DOUBLE AS units FROM turns GROUP BY conv_id"))
def compute_units(spark, sf):
    t = tables.turns(spark, sf)
    user = F.col("role") == "user"
    return t.groupBy("conv_id").agg(F.sum(num.compute_units(F.when(user, F.col("tokens")).otherwise(0), F.when(user, 0).otherwise(F.col("tokens")))).alias("units"))


@query("half_even_rounding", "SELECT k::DOUBLE / 8 AS x, round_even(k::DOUBLE / 8, 0) AS r FROM (SELECT DISTINCT event_id % 64 AS k FROM events)")
def half_even_rounding(spark, sf):
    e = tables.load(spark, sf, "events").select((F.col("event_id") % 64).alias("k")).distinct()
    return e.select((F.col("k") / 8).alias("x"), F.bround(F.col("k") / 8, 0).alias("r"))


@query("short_answers", r"""WITH r AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '**The** answer is 1,0' || (page_id % 10) || '.' WHEN 1 THEN 'It is: Paris!' WHEN 2 THEN 'parisian style' ELSE 'no idea, 7 or 42' END AS reply,
  CASE page_id % 4 WHEN 0 THEN '105' WHEN 3 THEN '42' ELSE 'paris' END AS answer, CASE WHEN page_id % 4 IN (0, 3) THEN 'number' ELSE 'word' END AS kind FROM pages)
SELECT page_id, CASE WHEN kind = 'number' THEN list_contains(regexp_extract_all(replace(lower(regexp_replace(reply, '[*_`"]', '', 'g')), ',', ''), '-?[0-9]+(?:\.[0-9]+)?')[1:3], answer)
  ELSE regexp_matches(lower(reply), '(?:^|[^a-z0-9_])' || answer || '(?:[^a-z0-9_]|$)') END AS correct FROM r""")
def short_answers(spark, sf):
    from ..operators.bench import correct

    n = F.col("page_id") % 4
    reply = F.when(n == 0, F.concat(F.lit("**The** answer is 1,0"), (F.col("page_id") % 10).cast("string"), F.lit("."))).when(n == 1, "It is: Paris!").when(n == 2, "parisian style").otherwise("no idea, 7 or 42")
    answer = F.when(n == 0, "105").when(n == 3, "42").otherwise("paris")
    kind = F.when(n.isin(0, 3), "number").otherwise("word")
    return tables.load(spark, sf, "pages").select("page_id", correct(reply, answer, kind).alias("correct"))


@query("wilson_by_source", """WITH c AS (SELECT source, count(*)::DOUBLE AS n, sum(quality)::DOUBLE AS k FROM documents JOIN labels USING (doc_id) GROUP BY source)
SELECT source, round(k / n, 9) AS p, round((k / n + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4 * n * n)) / (1 + 1.96 * 1.96 / n), 9) AS low,
  round((k / n + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4 * n * n)) / (1 + 1.96 * 1.96 / n), 9) AS high FROM c""")
def wilson_by_source(spark, sf):
    d = tables.load(spark, sf, "documents").select("doc_id", "source").join(tables.load(spark, sf, "labels"), "doc_id")
    c = d.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("quality").alias("k")).withColumn("w", num.wilson("k", "n"))
    return c.select("source", *[F.round(F.col(f"w.{x}"), 9).alias(x) for x in ("p", "low", "high")])
