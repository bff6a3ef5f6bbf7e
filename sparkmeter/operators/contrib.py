"""Contributed numbers: allow-list validation, public aggregates, k-anonymous labels, withdrawal.

Payloads arrive as JSON text. A payload is one bounded document (32 KB), so a rule is an expression
over its row; rules add messages to an array and a payload is valid when the array is empty.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import scale
from ..functions.numbers import SOURCES, label_ok, source_enum

# --- fixed values: the contribution schema ------------------------------------------------------
SCHEMA = "contribution.v1"
MAX_BYTES = 32768
MAX_LABELS = 7
MAX_TURNS = 400
MAX_LEDGER_ROWS = 1000
MAX_TOOLS = 60
MAX_SESSION_ROWS = 200
BIG = 1e12
LANGUAGES = ["ko", "en", "ja", "zh", "und"]
INTENTS = ["ask", "instruct", "clarify", "correct", "retry", "continue", "ack", "context", "answer", "code", "followup_question", "apology_fix", "refusal"]
EDGE_TYPES = ["NEXT", "ANSWERS", "DEEPENS", "REVISITS", "PIVOTS", "RETURNS", "CORRECTS", "RETRIES", "CONTINUES"]
LEDGER_PROVIDERS = ["openai", "anthropic", "claude-code"]
LEDGER_ACTIONS = ["forwarded", "forwarded+compacted", "cache_hit", "gratitude_local", "error", "agent_dup_read_blocked"]
SKELETON_COUNTS = ["user_turns", "assistant_turns", "visible_tokens", "billed_input_tokens", "billed_output_tokens", "compute_units",
                   "optimized_compute_units", "one_shot_compute_units", "max_depth", "branches"]
SKELETON_PCTS = ["savings_pct", "one_shot_savings_pct"]
WASTE = ["ack_units", "superseded_units", "offtopic_context_tokens"]
LEDGER_NUMS = ["requests", "input_tokens", "output_tokens", "reasoning_tokens", "history_tokens", "avoided_input", "avoided_output", "measured_requests"]
AGENT_NUMS = ["sessions", "api_calls", "subagent_calls", "compactions", "tool_calls", "peak_context"]
AGENT_PCTS = ["cache_hit_pct", "carried_share_pct"]
AGENT_TOKENS = ["input", "cache_read", "cache_write", "output", "processed_input"]
AGENT_PARTS = ["duplicate_reads", "large_results", "failed_repeats"]
AGENT_COST = ["count", "tokens", "carried_tokens"]
AGENT_TOOL = ["calls", "result_tokens", "carried_tokens", "errors", "images"]
BOUND_NUMS = ["sessions", "api_calls", "measured_input", "pinned_input", "written_tokens"]
BOUND_PCTS = ["P0", "P1000", "P10000", "Pinf"]
BOUND_METHODS = ["lexical-v1"]
MODEL = r"^[A-Za-z0-9._:/\-]{0,64}\z"
TOOL = r"^[A-Za-z][A-Za-z0-9_]{0,40}\z"
DAY = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"
VERSION = r"^[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\z"
K_ANON = 3
# -------------------------------------------------------------------------------------------------


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("MISSING"))


def _at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _is(v: Column, what: str) -> Column:
    return _kind(v).startswith(what)


def _num(v: Column) -> Column:
    """Number as double; null for anything else (booleans and numeric strings included)."""
    return F.when(_kind(v).rlike(r"^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(v, "$", "double"))


def _bad_number(v: Column, ints: bool, low: float = 0, high: float = BIG) -> Column:
    x = _num(v)
    ok = x.between(low, high) & ~F.isnan(x)
    return ~F.coalesce(ok & (x == F.floor(x)) if ints else ok, F.lit(False))


def _str(v: Column) -> Column:
    return F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _when(bad: Column, message: Column | str) -> Column:
    return F.when(F.coalesce(bad, F.lit(False)), F.lit(message) if isinstance(message, str) else message)


def _rules(*rules: Column) -> Column:
    return F.array_compact(F.array(*rules))


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _members(v: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))


def _keys(v: Column) -> Column:
    return F.map_keys(_members(v))


def _names(keys: Sequence[str]) -> Column:
    return F.array(*[F.lit(k) for k in keys])


def _key_errors(v: Column, where: str, allowed: Sequence[str], required: Sequence[str] | None = None) -> Column:
    """Not an object, unknown keys, missing keys."""
    required = allowed if required is None else required

    def check(keys: Column) -> Column:
        unknown = F.transform(F.array_except(keys, _names(allowed)), lambda k: F.concat(F.lit(f'{where}: unknown key "'), k, F.lit('"')))
        missing = F.transform(F.array_except(_names(required), keys), lambda k: F.concat(F.lit(f"{where}: missing "), k))
        return F.concat(unknown, missing)

    return F.when(~_is(v, "OBJECT"), F.array(F.lit(f"{where}: must be an object"))).otherwise(_let(_keys(v), check))


def _number_errors(v: Column, where: str, keys: Sequence[str], ints: bool = True, low: float = 0, high: float = BIG) -> Column:
    """Only for objects: a non-object already has its own message."""
    bad = _let(_members(v), lambda m: F.filter(_names(keys), lambda k: _bad_number(F.try_element_at(m, k), ints, low, high)))
    named = F.transform(bad, lambda k: F.concat(F.lit(f"{where}."), k, F.lit(": bad number")))
    return F.when(_is(v, "OBJECT"), named).otherwise(F.array().cast("array<string>"))


def _member_errors(v: Column, where: str, keys: Sequence[str], ints: bool = True, high: float = BIG) -> Column:
    return F.concat(_key_errors(v, where, keys), _number_errors(v, where, keys, ints, high=high))


def _items(v: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))


def _pairs(v: Column) -> Column:
    return F.coalesce(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), F.array().cast("array<struct<key:string,value:variant>>"))


def _then(errors: Column, more: Column) -> Column:
    """Consistency rules run only on documents without errors so far."""
    return _let(errors, lambda e: F.when(F.size(e) == 0, more).otherwise(e))


def _n(v: Column, path: str) -> Column:
    return F.coalesce(_num(_at(v, path)), F.lit(0.0))


def _sum(items: Column, value) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda a, x: a + F.coalesce(value(x), F.lit(0.0)))


def skeleton_errors(d: Column) -> Column:
    m, w, turns, edges, labels = (_at(d, f"$.{k}") for k in ("metrics", "waste", "turns", "edges", "labels"))
    keys = ["source", "language", "metrics", "waste", "turns", "edges"]
    ts = _items(turns)
    size_ok = _is(turns, "ARRAY") & F.size(ts).between(1, MAX_TURNS)

    def turn_ok(t: Column) -> Column:
        ints = [~_bad_number(_at(t, f"$[{i}]"), True) for i in (2, 3, 4)]
        return F.coalesce(_is(t, "ARRAY") & (F.size(_items(t)) == 6) & _str(_at(t, "$[0]")).isin("u", "a") & _str(_at(t, "$[1]")).isin(INTENTS)
                          & ints[0] & ints[1] & ints[2] & _num(_at(t, "$[5]")).isin(0.0, 1.0), F.lit(False))

    bad_turns = F.filter(F.transform(ts, lambda t, i: F.when(~turn_ok(t), F.concat(F.lit("data.turns["), i.cast("string"), F.lit("]: bad turn")))), lambda e: e.isNotNull())
    bad_edges = F.filter(F.transform(_pairs(edges), lambda e: F.when(~e["key"].isin(EDGE_TYPES), F.concat(F.lit('data.edges: unknown type "'), e["key"], F.lit('"')))
                                     .when(_bad_number(e["value"], True), F.concat(F.lit("data.edges."), e["key"], F.lit(": bad number")))), lambda e: e.isNotNull())
    ls = _items(labels)
    names = F.transform(ls, _str)
    labels_ok = _is(labels, "ARRAY") & (F.size(ls) <= MAX_LABELS) & F.forall(names, lambda s: label_ok(s)) & (F.size(F.array_distinct(names)) == F.size(names))
    errors = F.concat(
        _key_errors(d, "data", [*keys, "labels"], keys),
        _rules(_when(~F.coalesce(_str(_at(d, "$.source")).isin(SOURCES), F.lit(False)), "data.source: unknown"),
               _when(~F.coalesce(_str(_at(d, "$.language")).isin(LANGUAGES), F.lit(False)), "data.language: unknown")),
        _key_errors(m, "data.metrics", SKELETON_COUNTS + SKELETON_PCTS), _number_errors(m, "data.metrics", SKELETON_COUNTS),
        _number_errors(m, "data.metrics", SKELETON_PCTS, ints=False, low=-100, high=100),
        _member_errors(w, "data.waste", WASTE),
        F.when(size_ok, bad_turns).otherwise(F.array(F.lit(f"data.turns: 1..{MAX_TURNS} entries"))),
        F.when(_is(edges, "OBJECT"), bad_edges).otherwise(F.array(F.lit("data.edges: must be an object"))),
        _rules(_when(F.array_contains(_keys(d), "labels") & ~F.coalesce(labels_ok, F.lit(False)), f"data.labels: up to {MAX_LABELS} distinct short words")))
    users = F.size(F.filter(ts, lambda t: _str(_at(t, "$[0]")) == "u"))
    replies = F.size(ts) - users
    tokens = _sum(ts, lambda t: _num(_at(t, "$[4]")))
    n = lambda k: _n(m, f"$.{k}")
    whole = n("user_turns") + n("assistant_turns") <= MAX_TURNS
    consistent = _rules(
        _when(whole & ((users != n("user_turns")) | (replies != n("assistant_turns"))), "consistency: turn counts"),
        _when(whole & (tokens != n("visible_tokens")), "consistency: visible tokens"),
        _when(~whole & ((F.size(ts) != MAX_TURNS) | (users > n("user_turns")) | (replies > n("assistant_turns")) | (tokens > n("visible_tokens"))), "consistency: truncated turns"),
        _when(n("user_turns") < 1, "consistency: no user turns"),
        _when((n("optimized_compute_units") > n("compute_units")) | (n("one_shot_compute_units") > n("compute_units")), "consistency: optimized > actual"),
        _when(n("billed_output_tokens") > n("visible_tokens"), "consistency: billed output"))
    return _then(errors, consistent)


def ledger_errors(d: Column) -> Column:
    rows = _at(d, "$.rows")
    rs = _items(rows)

    def row(r: Column, i: Column) -> Column:
        where = F.concat(F.lit("data.rows["), i.cast("string"), F.lit("]"))
        text = lambda k: _str(_at(r, f"$.{k}"))
        not_ok = lambda c: ~F.coalesce(c, F.lit(False))
        local = F.concat(
            _key_errors(r, "", ["day", "provider", "model", "action", *LEDGER_NUMS]),
            F.when(_is(r, "OBJECT"), F.concat(_rules(
                _when(not_ok(text("day").rlike(DAY)), ".day: bad"), _when(not_ok(text("provider").isin(LEDGER_PROVIDERS)), ".provider: unknown"),
                _when(not_ok(text("model").rlike(MODEL)), ".model: bad"), _when(not_ok(text("action").isin(LEDGER_ACTIONS)), ".action: unknown"),
            ), _number_errors(r, "", LEDGER_NUMS))).otherwise(F.array().cast("array<string>")))
        local = _then(local, _rules(_when(_n(r, "$.measured_requests") > _n(r, "$.requests"), ": measured > requests")))
        return F.transform(local, lambda e: F.concat(where, e))

    ok = _is(rows, "ARRAY") & F.size(rs).between(1, MAX_LEDGER_ROWS)
    return F.concat(_key_errors(d, "data", ["rows"]), F.when(ok, F.flatten(F.transform(rs, row))).otherwise(F.array(F.lit(f"data.rows: 1..{MAX_LEDGER_ROWS} entries"))))


def bound_errors(b: Column) -> Column:
    a, rows = _at(b, "$.avoidable_pct"), _at(b, "$.per_session")
    rs = _items(rows)

    def row_ok(r: Column) -> Column:
        x = [_num(_at(r, f"$[{i}]")) for i in range(7)]
        in_range = x[2].between(0, 100) & x[3].between(0, 100) & x[4].between(0, 100) & x[5].between(0, 100) & x[6].between(0, 100)
        return F.coalesce(_is(r, "ARRAY") & (F.size(_items(r)) == 7) & ~_bad_number(_at(r, "$[0]"), True, 1) & ~_bad_number(_at(r, "$[1]"), True)
                          & in_range & (x[3] >= x[4]) & (x[4] >= x[5]) & (x[5] >= x[6]) & (x[3] <= 100 - x[2] + 0.1), F.lit(False))

    bad = F.filter(F.transform(rs, lambda r, i: F.when(~row_ok(r), F.concat(F.lit("data.bound.per_session["), i.cast("string"), F.lit("]: bad row")))), lambda e: e.isNotNull())
    errors = F.concat(
        _key_errors(b, "data.bound", ["method", *BOUND_NUMS, "tokenizer_factor", "avoidable_pct", "per_session"]),
        _rules(_when(~F.coalesce(_str(_at(b, "$.method")).isin(BOUND_METHODS), F.lit(False)), "data.bound.method: unknown")),
        _number_errors(b, "data.bound", BOUND_NUMS), _number_errors(b, "data.bound", ["tokenizer_factor"], ints=False, high=20),
        _member_errors(a, "data.bound.avoidable_pct", BOUND_PCTS, ints=False, high=100),
        F.when(_is(rows, "ARRAY") & F.size(rs).between(1, MAX_SESSION_ROWS), bad).otherwise(F.array(F.lit(f"data.bound.per_session: 1..{MAX_SESSION_ROWS} rows"))))
    p = [_n(a, f"$.{k}") for k in BOUND_PCTS]
    measured, pinned, sessions = _n(b, "$.measured_input"), _n(b, "$.pinned_input"), _n(b, "$.sessions")
    totals_off = (_sum(rs, lambda r: _num(_at(r, "$[0]"))) != _n(b, "$.api_calls")) | (_sum(rs, lambda r: _num(_at(r, "$[1]"))) != measured)
    n_rows = F.size(rs)
    return _then(errors, _rules(
        _when(~((p[0] >= p[1]) & (p[1] >= p[2]) & (p[2] >= p[3])), "consistency: bound policies out of order"),
        F.when(pinned > measured, "consistency: pinned > measured").when((measured > 0) & (p[0] > 100 * (measured - pinned) / measured + 0.1), "consistency: bound above ceiling"),
        F.when(n_rows != F.least(sessions, F.lit(float(MAX_SESSION_ROWS))), "consistency: bound session rows").when((n_rows == sessions) & totals_off, "consistency: bound session totals")))


def agent_errors(d: Column) -> Column:
    keys = ["agent", *AGENT_NUMS, *AGENT_PCTS, "tokens", *AGENT_PARTS, "by_tool"]
    t, bt, b = _at(d, "$.tokens"), _at(d, "$.by_tool"), _at(d, "$.bound")

    def tool(e: Column) -> Column:
        at = F.concat(F.lit("data.by_tool."), e["key"])
        named = F.transform(_member_errors(e["value"], "", AGENT_TOOL), lambda m: F.concat(at, m))
        bad = ~e["key"].rlike(TOOL) | e["key"].startswith("mcp__")
        return F.when(bad, F.array(F.concat(F.lit('data.by_tool: bad tool name "'), e["key"], F.lit('"')))).otherwise(named)

    tools = _pairs(bt)
    errors = F.concat(
        _key_errors(d, "data", [*keys, "bound"], keys),
        _rules(_when(~F.coalesce(_str(_at(d, "$.agent")) == "claude-code", F.lit(False)), "data.agent: unknown")),
        _number_errors(d, "data", AGENT_NUMS), _number_errors(d, "data", AGENT_PCTS, ints=False, high=100),
        _member_errors(t, "data.tokens", AGENT_TOKENS),
        *[_member_errors(_at(d, f"$.{k}"), f"data.{k}", AGENT_COST) for k in AGENT_PARTS],
        F.when(~_is(bt, "OBJECT"), F.array(F.lit("data.by_tool: must be an object"))).otherwise(
            F.concat(_rules(_when(F.size(tools) > MAX_TOOLS, "data.by_tool: too many tools")), F.flatten(F.transform(tools, tool)))),
        F.when(F.array_contains(_keys(d), "bound"), bound_errors(b)).otherwise(F.array().cast("array<string>")))
    return _then(errors, _rules(_when(_n(t, "$.processed_input") != _n(t, "$.input") + _n(t, "$.cache_read") + _n(t, "$.cache_write"), "consistency: processed_input")))


RULES = {"skeleton": skeleton_errors, "ledger": ledger_errors, "agent": agent_errors}


def validate(contributions: DataFrame, schema: str = SCHEMA, kinds: Sequence[str] = tuple(RULES)) -> DataFrame:
    """Adds ``errors``. contributions: payload JSON text. A table kept per kind needs only that kind's rules."""
    v = F.col("_v")
    head = F.concat(
        _key_errors(v, "payload", ["schema", "kind", "client", "version", "data"]),
        _rules(_when(~F.coalesce(_str(_at(v, "$.schema")) == schema, F.lit(False)), "payload.schema: unknown"),
               _when(~F.coalesce(_str(_at(v, "$.client")).isin("web", "cli"), F.lit(False)), "payload.client: unknown"),
               _when(~F.coalesce(_str(_at(v, "$.version")).rlike(VERSION), F.lit(False)), "payload.version: bad")))
    kind, d = _str(_at(v, "$.kind")), _at(v, "$.data")
    body = F.array(F.lit("payload.kind: unknown"))
    for k in kinds:
        body = F.when(kind == k, RULES[k](d)).otherwise(body)
    size = F.octet_length(F.to_json(v))
    errors = F.when(v.isNull(), F.array(F.lit("not serializable"))) \
        .when(size > MAX_BYTES, F.array(F.concat(F.lit("too large ("), size.cast("string"), F.lit(f" bytes > {MAX_BYTES})")))) \
        .otherwise(_let(head, lambda h: F.when(F.size(h) > 0, h).otherwise(body)))
    return contributions.withColumn("_v", F.try_parse_json("payload")).withColumn("errors", errors).drop("_v")


def valid(contributions: DataFrame, schema: str = SCHEMA, kinds: Sequence[str] = tuple(RULES)) -> DataFrame:
    """Stored data is validated again on read."""
    return validate(contributions, schema, kinds).where(F.size("errors") == 0).drop("errors")


# ---------------------------------------------------------------- builders


def skeleton_payload(metrics: DataFrame, nodes: DataFrame, edges: DataFrame, languages: DataFrame, agenda: DataFrame | None = None,
                     source: str = "other", client: str = "cli", version: str = "0.1.0") -> DataFrame:
    """(conv_id, payload): numbers of one conversation, its first 400 turns, edge counts and up to seven labels."""
    cap = nodes.where(F.col("idx") < MAX_TURNS)
    turn = F.concat(F.lit("["), F.when(F.col("role") == "user", '"u"').otherwise('"a"'), F.lit(',"'), "intent", F.lit('",'),
                    F.concat_ws(",", "depth", "branch", "tokens", F.col("redundant").cast("int")), F.lit("]"))
    t = cap.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", turn.alias("t")))), lambda e: e["t"]).alias("turns"))
    e = edges.groupBy("conv_id", "type").agg(F.count(F.lit(1)).alias("n")).groupBy("conv_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("edges"))
    m = metrics.join(t, "conv_id").join(e, "conv_id", "left").join(languages, "conv_id")
    r = lambda c: F.round(c).cast("bigint")
    met = F.struct("user_turns", "assistant_turns", "visible_tokens", F.col("billed_input").alias("billed_input_tokens"), F.col("billed_output").alias("billed_output_tokens"),
                   r("units").alias("compute_units"), r("opt_units").alias("optimized_compute_units"), r("one_shot_units").alias("one_shot_compute_units"),
                   F.round("savings_pct", 1).alias("savings_pct"), F.round("one_shot_savings_pct", 1).alias("one_shot_savings_pct"), "max_depth", "branches")
    waste = F.struct(r("ack_units").alias("ack_units"), r("superseded_units").alias("superseded_units"), F.col("offtopic_tokens").alias("offtopic_context_tokens"))
    labels = F.lit("")
    if agenda is not None:
        l = agenda.where(label_ok("word")).groupBy("conv_id").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]), 1, MAX_LABELS).alias("labels"))
        m = m.join(l, "conv_id", "left")
        labels = F.coalesce(F.concat(F.lit(',"labels":'), F.to_json(F.col("labels"))), F.lit(""))
    data = F.concat(F.lit('{"source":"'), source_enum(F.lit(source)), F.lit('","language":"'), "language", F.lit('","metrics":'), F.to_json(met), F.lit(',"waste":'), F.to_json(waste),
                    F.lit(',"turns":['), F.array_join("turns", ","), F.lit('],"edges":'), F.coalesce(F.to_json("edges"), F.lit("{}")), labels, F.lit("}"))
    return m.select("conv_id", _envelope("skeleton", data, client, version).alias("payload"))


def _envelope(kind: str, data: Column, client: str, version: str) -> Column:
    return F.concat(F.lit(f'{{"schema":"{SCHEMA}","kind":"{kind}","client":"{client}","version":"{version}","data":'), data, F.lit("}"))


def ledger_payload(daily: DataFrame, client: str = "cli", version: str = "0.1.0") -> DataFrame:
    """(part, payload): daily rows in envelopes of at most the row limit."""
    row = F.to_json(F.struct(F.date_format("day", "yyyy-MM-dd").alias("day"), "provider", "model", "action", *LEDGER_NUMS))
    d = daily.select("day", "provider", "model", "action", row.alias("r"))
    d = scale.scan(d.withColumn(scale.BLOCK, F.datediff("day", F.lit("1970-01-01"))), [], ["day", "provider", "model", "action"], i=scale.row_index())
    d = d.groupBy(F.floor(F.col("i") / 100).alias("part")).agg(F.array_join(F.array_sort(F.collect_list("r")), ",").alias("rows"))
    return d.select("part", _envelope("ledger", F.concat(F.lit('{"rows":['), "rows", F.lit("]}")), client, version).alias("payload"))


def agent_payload(merged: DataFrame, tools: DataFrame, client: str = "cli", version: str = "0.1.0") -> DataFrame:
    """One payload from a merged audit and its by-tool rows (names collapsed)."""
    part = lambda p: F.struct(F.col(f"{p}_count").alias("count"), F.col(f"{p}_tokens").alias("tokens"), F.col(f"{p}_carried").alias("carried_tokens"))
    by_tool = tools.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", F.struct(*AGENT_TOOL))))).alias("by_tool"))
    data = F.to_json(F.struct(
        F.lit("claude-code").alias("agent"), "sessions", "api_calls", "subagent_calls", "compactions", "tool_calls", F.round("cache_hit_pct", 1).alias("cache_hit_pct"),
        "peak_context", F.least(F.lit(100.0), F.round("carried_share_pct", 1)).alias("carried_share_pct"), F.struct(*AGENT_TOKENS).alias("tokens"),
        part("dup").alias("duplicate_reads"), part("large").alias("large_results"), part("failed").alias("failed_repeats"), "by_tool"))
    return merged.join(F.broadcast(by_tool)).select(_envelope("agent", data, client, version).alias("payload"))  # one row each


# ---------------------------------------------------------------- public aggregate


def _data(contribs: DataFrame, kind: str) -> DataFrame:
    v = F.try_parse_json("payload")
    return contribs.withColumn("_v", v).where(_str(_at(F.col("_v"), "$.kind")) == kind).withColumn("d", _at(F.col("_v"), "$.data")).drop("_v")


def contribution_counts(contribs: DataFrame) -> DataFrame:
    """By kind and verified flag, with totals."""
    k = contribs.select("verified", F.try_variant_get(F.try_parse_json("payload"), "$.kind", "string").alias("kind"))
    return k.cube("kind", "verified").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


def skeleton_aggregate(contribs: DataFrame) -> DataFrame:
    s = _data(contribs, "skeleton")
    d = F.col("d")
    num = lambda p: _num(_at(d, p))
    r = s.select(*[num(f"$.metrics.{k}").alias(k) for k in SKELETON_COUNTS + SKELETON_PCTS], *[num(f"$.waste.{k}").alias(k) for k in WASTE])
    t = r.agg(F.count(F.lit(1)).alias("conversations"), *[F.sum(c).cast("bigint").alias(c) for c in ("compute_units", "optimized_compute_units", "billed_input_tokens", "visible_tokens", *WASTE)])
    med = scale.exact_percentiles(r, [], "savings_pct", median_savings_pct=0.5)
    t = t.withColumn("avoidable_pct", F.when(F.col("compute_units") > 0, 100 * (1 - F.col("optimized_compute_units") / F.col("compute_units"))).otherwise(0.0))
    return t.join(F.broadcast(med))  # one row each


def skeleton_counts(contribs: DataFrame) -> DataFrame:
    """(dimension, value, n): intents over turns, languages and sources over conversations."""
    d = F.col("d")
    rows = _data(contribs, "skeleton").select(F.inline(F.concat(
        F.array(F.struct(F.lit("language").alias("dimension"), _str(_at(d, "$.language")).alias("value")), F.struct(F.lit("source").alias("dimension"), _str(_at(d, "$.source")).alias("value"))),
        F.transform(_items(_at(d, "$.turns")), lambda t: F.struct(F.lit("intent").alias("dimension"), _str(_at(t, "$[1]")).alias("value"))))))
    return rows.groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"))


def ledger_aggregate(contribs: DataFrame) -> DataFrame:
    """Sums over contributed ledger rows, by action and overall (null)."""
    rows = _data(contribs, "ledger").select(F.explode(_items(_at(F.col("d"), "$.rows"))).alias("r"))
    r = F.col("r")
    n = rows.select(_str(_at(r, "$.action")).alias("action"), *[_num(_at(r, f"$.{k}")).cast("bigint").alias(k) for k in LEDGER_NUMS])
    return n.groupingSets([["action"], []], "action").agg(*[F.sum(k).alias(k) for k in LEDGER_NUMS])


def agent_aggregate(contribs: DataFrame) -> DataFrame:
    a = _data(contribs, "agent")
    num = lambda p: _num(_at(F.col("d"), p))
    r = a.select(*[num(f"$.{k}").alias(k) for k in (*AGENT_NUMS, *AGENT_PCTS)], num("$.tokens.processed_input").alias("processed_input"),
                 *[num(f"$.{p}.count").alias(p) for p in AGENT_PARTS], (num("$.duplicate_reads.carried_tokens") + num("$.large_results.carried_tokens")).alias("carried_tokens"))
    t = r.agg(F.count(F.lit(1)).alias("contributions"), *[F.sum(c).cast("bigint").alias(c) for c in ("sessions", "api_calls", "processed_input", "duplicate_reads", "large_results", "carried_tokens")])
    for v, n in (("cache_hit_pct", "median_cache_hit_pct"), ("peak_context", "median_peak_context")):
        t = t.join(F.broadcast(scale.exact_percentiles(r, [], v, **{n: 0.5})))  # one row each
    return t


def bound_quartiles(contribs: DataFrame) -> DataFrame:
    """(measure, q1, median, q3) over contributed sessions."""
    rows = _data(contribs, "agent").select(F.explode(_items(_at(F.col("d"), "$.bound.per_session"))).alias("r"))
    r = F.col("r")
    long = rows.select(F.inline(F.array(*[F.struct(F.lit(k).alias("measure"), _num(_at(r, f"$[{i + 2}]")).alias("v")) for i, k in enumerate(["pinned_pct", *BOUND_PCTS])])))
    return scale.exact_percentiles(long, ["measure"], "v", q1=0.25, median=0.5, q3=0.75)


def label_counts(labels: DataFrame, anonymous: DataFrame | None = None, k: int = K_ANON, top: int = 100) -> DataFrame:
    """labels: (id, label). Labels at least k contributions share, most frequent first. anonymous:
    (label, n) counts that arrive already filtered."""
    c = labels.distinct().groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    if anonymous is not None:
        c = c.unionByName(anonymous.select("label", "n")).groupBy("label").agg(F.sum("n").alias("n"))
    return c.where(F.col("n") >= k).orderBy(F.desc("n"), "label").limit(top)


def label_pairs(labels: DataFrame, anonymous: DataFrame | None = None, k: int = K_ANON, top: int = 300) -> DataFrame:
    """Pairs of labels of one contribution (at most seven labels), counted over contributions."""
    a = labels.distinct().groupBy("id").agg(F.array_sort(F.collect_set("label")).alias("ls"))
    p = a.select(F.posexplode("ls").alias("i", "a"), "ls").select("a", F.explode(F.expr("slice(ls, i + 2, size(ls))")).alias("b"))
    c = p.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    if anonymous is not None:
        x = anonymous.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "n")
        c = c.unionByName(x).groupBy("a", "b").agg(F.sum("n").alias("n"))
    return c.where(F.col("n") >= k).orderBy(F.desc("n"), "a", "b").limit(top)


def contributed_labels(contribs: DataFrame) -> DataFrame:
    """(id, label) of skeleton contributions."""
    return _data(contribs, "skeleton").select("id", F.explode(F.transform(_items(_at(F.col("d"), "$.labels")), _str)).alias("label"))


def withdraw(contribs: DataFrame, requests: DataFrame) -> DataFrame:
    """What is left after withdrawals by the original author or with the right token.
    contribs: id, author, token_hash. requests: (id, author, token), either of the two null."""
    r = requests.select("id", F.col("author").alias("_a"), F.sha2("token", 256).alias("_t"))
    gone = contribs.select("id", "author", "token_hash").join(r, "id").where((F.col("author") == F.col("_a")) | (F.col("token_hash") == F.col("_t")))
    return contribs.join(gone.select("id"), "id", "left_anti")


def page_after(contribs: DataFrame, after: int, limit: int = 1000) -> DataFrame:
    """Keyset page by seq; the filter reaches the scan."""
    return contribs.where(F.col("seq") > after).orderBy("seq").limit(limit)
