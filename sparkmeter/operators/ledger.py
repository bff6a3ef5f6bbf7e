"""Request logs of a gateway: what each request re-sent, what could have been avoided, and the ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import scale
from ..functions.intent import is_gratitude
from ..functions.numbers import epoch_day, percent
from ..functions.text import estimate_tokens

# --- fixed values ---------------------------------------------------------------------------
MESSAGE_OVERHEAD = 4
MAX_GRATITUDE_REPLY_TOKENS = 120
TYPICAL_REPLY_TOKENS = 40
CACHE_TTL_SECONDS = 7 * 24 * 3600
VOLATILE_KEYS = ["stream", "stream_options", "user", "metadata", "store"]
COUNTS = ["input_tokens", "output_tokens", "reasoning_tokens", "cached_input_tokens", "history_tokens", "avoided_input", "avoided_output"]
# ---------------------------------------------------------------------------------------------
REQ = ["request_id"]


def message_features(messages: DataFrame) -> DataFrame:
    """messages: (request_id, pos, role, text, plain). Adds tokens and the messages around each one."""
    m = messages.withColumn("tokens", estimate_tokens("text"))
    return scale.scan(m, REQ, ["pos"], p_role=scale.previous(F.col("role")), p_text=scale.previous(F.col("text")),
                      n_role=scale.following(F.col("role")), n_tokens=scale.following(F.col("tokens")), n_plain=scale.following(F.col("plain")),
                      n2=scale.following(F.lit(1)))


def estimates(messages: DataFrame, systems: DataFrame | None = None) -> DataFrame:
    """(request_id, n_messages, input_estimate, last_user_tokens)."""
    tokens = estimate_tokens("text")
    m = messages.withColumn("tokens", tokens)
    user = F.col("role") == "user"
    e = m.groupBy(*REQ).agg(F.count(F.lit(1)).alias("n_messages"), F.sum(F.col("tokens") + MESSAGE_OVERHEAD).alias("input_estimate"),
                            F.coalesce(F.max_by("tokens", F.when(user, F.col("pos"))), F.lit(0)).alias("last_user_tokens"))
    if systems is not None:
        e = e.join(systems.select(*REQ, estimate_tokens("system").alias("_s")), REQ, "left")
        e = e.withColumn("input_estimate", F.col("input_estimate") + F.coalesce("_s", F.lit(0))).drop("_s")
    return e.withColumn("history_tokens", F.greatest(F.lit(0), F.col("input_estimate") - F.col("last_user_tokens")))


def gratitude_requests(messages: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, gratitude_only): the last message is a bare thank-you after an answer that asked nothing."""
    m = message_features(messages)
    last = m.where("n_role IS NULL")
    settled = (F.col("p_role") == "assistant") & ~F.regexp_replace("p_text", r"(?U)\s+\z", "").rlike("[?？]\\z")
    only = (F.col("role") == "user") & F.col("plain") & is_gratitude("text") & settled
    out = last.select(*REQ, F.coalesce(only, F.lit(False)).alias("_only"))
    return requests.select(*REQ, "has_tools").join(out, REQ, "left").select(*REQ, (~F.col("has_tools") & F.coalesce("_only", F.lit(False))).alias("gratitude_only"))


def compactions(messages: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, removed): tokens of earlier (thank-you, short reply) pairs. Pairs start at a prompt and end
    at a reply, so none overlap; the latest exchange is never touched."""
    m = message_features(messages)
    m = scale.scan(m, REQ, ["pos"], n2_role=scale.following(F.col("n_role")))
    pair = (F.col("role") == "user") & (F.col("n_role") == "assistant") & F.col("plain") & F.col("n_plain") & is_gratitude("text") \
        & (F.col("n_tokens") <= MAX_GRATITUDE_REPLY_TOKENS) & F.col("n2_role").isNotNull()
    r = m.where(pair).groupBy(*REQ).agg(F.sum(8 + F.col("tokens") + F.col("n_tokens")).alias("_r"))
    return requests.select(*REQ, "has_tools").join(r, REQ, "left").select(*REQ, F.when(F.col("has_tools"), 0).otherwise(F.coalesce("_r", F.lit(0))).cast("bigint").alias("removed"))


def request_key(provider: Column, body: Column) -> Column:
    """Digest of a request body (JSON text) without its volatile keys; keys are in sorted order at every depth."""
    ordered = F.coalesce(F.to_json(F.try_parse_json(body)), body)  # object keys come back sorted
    m = F.map_filter(F.from_json(ordered, "map<string,string>"), lambda k, _: ~k.isin(VOLATILE_KEYS))
    entries = F.array_sort(F.map_entries(m))
    return F.sha2(F.concat(provider, F.lit("\n"), F.to_json(F.struct(entries.alias("e")))), 256)


def cacheable(cache_all: bool = False) -> Column:
    same = F.lit(True) if cache_all else (F.coalesce(F.col("temperature") == 0, F.lit(False)) & (F.coalesce("n", F.lit(1)) == 1))
    return ~F.col("has_tools") & ~F.col("stream") & same


def cache_hits(requests: DataFrame, ttl: float = CACHE_TTL_SECONDS, block_rows: int = 20_000) -> DataFrame:
    """(request_id, hit). requests: (request_id, key, at seconds). A request hits while the last miss of its
    key is at most ttl old; hits do not extend it. A gap over the ttl always misses, so each key falls into
    runs that are folded on their own."""
    r = scale.scan(requests, ["key"], ["at", "request_id"], _gap=scale.previous(F.col("at")))
    fresh = F.col("_gap").isNull() | (F.col("at") - F.col("_gap") > ttl)
    r = r.withColumn("_new", fresh.cast("bigint"))
    r = scale.scan(r, ["key"], ["at", "request_id"], run=scale.running_sum(F.col("_new")))
    r = scale.scan(r, ["key", "run"], ["at", "request_id"], i=scale.row_index())
    item = F.struct(F.col("at").cast("double").alias("at"), "i")
    kind = "struct<last:double,misses:array<bigint>>"
    none = F.array().cast("array<bigint>")
    first = F.struct(F.lit(None).cast("double").alias("last"), none.alias("misses")).cast(kind)

    def step(s, e, p):
        miss = F.coalesce(e["at"] - s["last"] > ttl, F.lit(True))
        return F.struct(F.when(miss, e["at"]).otherwise(s["last"]).alias("last"),
                        F.when(miss, F.concat(s["misses"], F.array(e["i"]))).otherwise(s["misses"]).alias("misses")).cast(kind)

    done = scale.fold(r, ["key", "run"], "i", item, [], first, first, step, lambda s: F.struct(s["last"].alias("last"), none.alias("misses")).cast(kind), block_rows)
    misses = done.select("key", "run", F.explode("state.misses").alias("i"), F.lit(True).alias("_m"))
    return r.join(misses, ["key", "run", "i"], "left").select("request_id", F.col("_m").isNull().alias("hit"))


def outcomes(requests: DataFrame) -> DataFrame:
    """What a gateway would have done: requests with input_estimate, last_user_tokens, gratitude_only,
    removed, hit, and the reported usage (nullable)."""
    est = F.col("input_estimate") - F.col("removed")
    action = F.when(F.col("gratitude_only"), "gratitude_local").when(F.coalesce("hit", F.lit(False)), "cache_hit") \
        .when(F.col("failed"), "error").when(F.col("removed") > 0, "forwarded+compacted").otherwise("forwarded")
    r = requests.withColumn("action", action)
    sent = F.col("action").startswith("forwarded")
    used_in = F.when(sent, F.coalesce("usage_input", est)).otherwise(0)
    r = r.withColumns({
        "measured": sent & F.col("usage_input").isNotNull(), "input_tokens": used_in,
        "output_tokens": F.when(sent, F.coalesce("usage_output", F.lit(0))).otherwise(0),
        "avoided_input": F.when(F.col("action").isin("gratitude_local", "cache_hit"), F.col("input_estimate")).when(sent, F.col("removed")).otherwise(0),
        "avoided_output": F.when(F.col("action") == "gratitude_local", TYPICAL_REPLY_TOKENS).when(F.col("action") == "cache_hit", F.coalesce("usage_output", F.lit(0))).otherwise(0)})
    return r.withColumn("history_tokens", F.when(sent, F.greatest(F.lit(0), F.col("input_tokens") - F.col("last_user_tokens"))).otherwise(0))


def ledger(rows: DataFrame) -> DataFrame:
    """Counts only, missing ones 0."""
    have = set(rows.columns)
    n = [(F.coalesce(c, F.lit(0)) if c in have else F.lit(0)).cast("bigint").alias(c) for c in COUNTS]
    flag = lambda c: (F.coalesce(F.col(c).cast("int"), F.lit(0)) if c in have else F.lit(0)).cast("bigint").alias(c)
    return rows.select("ts", "provider", "model", "action", flag("streamed"), flag("measured"), *n)


def _sums() -> list[Column]:
    return [F.count(F.lit(1)).alias("requests"), *[F.sum(c).alias(c) for c in COUNTS], F.sum("measured").alias("measured_requests")]


def summary(led: DataFrame) -> DataFrame:
    """Per provider, model and action, with rollup totals; shares recomputed at each level."""
    g = led.rollup("provider", "model", "action").agg(*_sums(), F.grouping_id().alias("level"))
    spent = F.col("input_tokens") + F.col("output_tokens")
    avoided = F.col("avoided_input") + F.col("avoided_output")
    return g.withColumns({"history_share_pct": percent("history_tokens", "input_tokens"), "avoided_pct": percent(avoided, spent + avoided)})


def daily(led: DataFrame) -> DataFrame:
    """Anonymous export: nothing finer than a day."""
    day = F.to_date("ts") if dict(led.dtypes)["ts"].startswith("timestamp") else epoch_day("ts")
    return led.groupBy(day.alias("day"), "provider", "model", "action").agg(*_sums()).drop("cached_input_tokens")


# ---------------------------------------------------------------- usage


def usage(provider: Column, body: Column) -> Column:
    """Usage of a response (VARIANT) in either provider's dialect: struct or null."""
    n = lambda path: F.coalesce(F.try_variant_get(body, "$.usage." + path, "bigint"), F.lit(0))
    have = F.try_variant_get(body, "$.usage", "map<string,variant>").isNotNull()
    names = ["input_tokens", "output_tokens", "reasoning_tokens", "cached_input_tokens"]
    first = [n("prompt_tokens"), n("completion_tokens"), n("completion_tokens_details.reasoning_tokens"), n("prompt_tokens_details.cached_tokens")]
    read = n("cache_read_input_tokens")
    second = [n("input_tokens") + read + n("cache_creation_input_tokens"), n("output_tokens"), F.lit(0).cast("bigint"), read]
    build = lambda cols: F.struct(*[c.alias(k) for c, k in zip(cols, names)])
    return F.when(have, F.when(provider == "openai", build(first)).otherwise(build(second)))


def parse_chunk(chunks: DataFrame) -> DataFrame:
    """chunks: (request_id, provider, seq, data). One server-sent line each: what it says about usage, and
    its text delta. Lines that are not data, or not JSON, say nothing."""
    data = F.trim(F.regexp_extract("data", r"(?s)^\s*data:(.*)\z", 1))
    v = F.try_parse_json(F.when((data != "") & (data != "[DONE]"), data))
    c = chunks.withColumn("v", v)
    num = lambda path: F.try_variant_get("v", path, "bigint")
    openai = F.col("provider") == "openai"
    u = usage(F.lit("openai"), F.col("v"))
    start = F.try_variant_get("v", "$.type", "string") == "message_start"
    m = usage(F.lit("anthropic"), F.try_variant_get("v", "$.message", "variant"))
    delta = F.try_variant_get("v", "$.type", "string") == "message_delta"
    parts = F.try_variant_get("v", "$.choices", "array<variant>")
    said = F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_variant_get(p, "$.delta.content", "string"), F.lit(""))), "")
    return c.withColumns({
        "u_input": F.when(openai, u["input_tokens"]).when(start, F.coalesce(m["input_tokens"], F.lit(0))),
        "u_cached": F.when(openai, u["cached_input_tokens"]).when(start, F.coalesce(m["cached_input_tokens"], F.lit(0))),
        "u_output": F.when(openai, u["output_tokens"]).when(delta, F.coalesce(num("$.usage.output_tokens"), F.lit(0))),
        "u_reasoning": F.when(openai, u["reasoning_tokens"]),
        "said": F.when(openai, said).when(F.try_variant_get("v", "$.type", "string") == "content_block_delta", F.try_variant_get("v", "$.delta.text", "string")),
        "is_end": F.coalesce((F.trim("data") == "data: [DONE]") | (F.try_variant_get("v", "$.type", "string") == "message_stop"), F.lit(False)),
    }).drop("v")


def metered(chunks: DataFrame, requests: DataFrame) -> DataFrame:
    """Usage per streamed request: the last report of each number, else estimates from the
    reply text (one reply is one message, so its chunks fit a row)."""
    p = parse_chunk(chunks)
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.coalesce("said", F.lit("")).alias("t")))), lambda e: e["t"]), "")
    g = p.groupBy("request_id").agg(last("u_input").alias("i"), last("u_output").alias("o"), last("u_reasoning").alias("r"), last("u_cached").alias("c"), text.alias("t"))
    g = g.join(requests.select("request_id", "input_estimate"), "request_id")
    return g.select("request_id", F.coalesce("i", "input_estimate").alias("input_tokens"), F.coalesce("o", estimate_tokens("t")).alias("output_tokens"),
                    F.coalesce("r", F.lit(0)).alias("reasoning_tokens"), F.coalesce("c", F.lit(0)).alias("cached_input_tokens"),
                    (F.col("i").isNotNull() & F.col("o").isNotNull()).alias("measured"))
