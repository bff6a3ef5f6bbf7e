"""Hand-computed cases of single operators."""

import json
import math

import pytest
from pyspark.sql import functions as F

from sparkmeter.functions import numbers, text
from sparkmeter.operators import audit, bound, chat, floor, labels, policy, rules, whatif
from sparkmeter.sources import agent_logs as al


def lines(spark, docs, session="s"):
    rows = [(session, i, 0, i, d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)]
    raw = spark.createDataFrame(rows, "session_id string, at bigint, rank bigint, pos bigint, value string")
    return al.index_lines(al.parse_lines(raw))


def call(mid, ctx=1000, blocks=(), **over):
    usage = {"input_tokens": 5, "cache_read_input_tokens": ctx, "cache_creation_input_tokens": 0, "output_tokens": 9, **over.pop("usage", {})}
    return {"type": "assistant", "sessionId": "s", "message": {"id": mid, "model": over.pop("model", "m"), "usage": usage, "content": list(blocks)}, **over}


def use(tid, name, **arg):
    return {"type": "tool_use", "id": tid, "name": name, "input": arg}


def result(tid, content="fine", **kw):
    return {"type": "user", "sessionId": "s", "message": {"content": [{"type": "tool_result", "tool_use_id": tid, "content": content, **kw}]}}


def prompt(t, **kw):
    return {"type": "user", "sessionId": "s", "message": {"content": t}, **kw}


BOUNDARY = {"type": "system", "subtype": "compact_boundary"}


def test_usage_counts_once_and_bad_lines_are_skipped(spark):
    ix = lines(spark, [call("a", blocks=[{"type": "text", "text": "hello"}]), call("a", blocks=[use("t", "Read", file_path="/x")]), "not json", "[1]", call("z", 0, usage={"input_tokens": 0})])
    assert al.calls(ix).count() == 1
    assert al.calls(ix).first()["context"] == 1005
    raw = [("s", i, 0, i, json.dumps(d)) for i, d in enumerate([call("a"), call("z", 0, usage={"input_tokens": 0})])]
    raw = spark.createDataFrame(raw, "session_id string, at bigint, rank bigint, pos bigint, value string")
    audit_calls = al.calls(al.index_lines(al.parse_lines(raw), audit_mode=True))
    assert audit_calls.count() == 2


def test_audit_duplicates_large_failures_and_carry(spark):
    docs = [call("a", blocks=[use("1", "Read", file_path="/f")]), result("1", "x" * 9000), call("b", blocks=[use("2", "Read", file_path="/f")]), result("2", "x" * 40),
            call("c", blocks=[use("3", "Bash", command="q")]), result("3", "bad", is_error=True), call("d", blocks=[use("4", "Bash", command="q")]), result("4", "bad", is_error=True),
            call("e", blocks=[use("5", "Write", file_path="/f", content="n")]), result("5"), call("f", blocks=[use("6", "Read", file_path="/f")]), result("6")]
    ix = lines(spark, docs)
    a = audit.audit(al.calls(ix), al.tool_uses(ix)).first()
    assert (a["dup_count"], a["large_count"], a["failed_count"]) == (1, 1, 1)  # the read after the write is no duplicate
    assert a["large_tokens"] == 2250 and a["large_carried"] == 2250 * 5


def test_compaction_resets_duplicates_and_carry(spark):
    ix = lines(spark, [call("a", blocks=[use("1", "Read", file_path="/f")]), result("1", "y" * 40), BOUNDARY, call("b", blocks=[use("2", "Read", file_path="/f")]), result("2", "y" * 40), call("c")])
    a = audit.audit(al.calls(ix), al.tool_uses(ix)).first()
    assert a["dup_count"] == 0 and a["compactions"] == 1 and a["carried_tokens"] == 10


def test_floor_categories_and_churn(spark):
    docs = [prompt("go"), call("a", blocks=[use("1", "Read", file_path="/f")]), result("1", "same"), call("b", blocks=[use("2", "Read", file_path="/f")]), result("2", "same"),
            call("c", blocks=[use("3", "Bash", command="x")]), result("3", "boom", is_error=True),
            call("d", 0, usage={"input_tokens": 5, "cache_read_input_tokens": 0, "cache_creation_input_tokens": 11000})]
    ix = lines(spark, docs)
    uses = al.tool_uses(ix).join(al.step_text(ix), ["session_id", "ctx_key", "call_k"], "left")
    judged = floor.judged_results(uses)
    assert {(r["use_id"], r["category"]) for r in judged.where("category IS NOT NULL").collect()} == {("2", "W1"), ("3", "W2")}
    ev = floor.churn(al.calls(ix))
    assert [r["tokens"] for r in ev.collect()] == [1005]
    assert abs(ev.first()["price_units"] - 1005 * 1.15) < 1e-9
    steps = floor.wasted_steps(judged, uses, al.calls(ix))
    assert {(r["category"], r["input"]) for r in steps.collect()} == {("W1", 1005), ("W2", 1005)}
    flags = {(r["instr"], r["category"]) for r in floor.instruction_flags(judged, ev).collect()}
    assert flags == {(1, "W1"), (1, "W2"), (1, "W6")}


def test_a_repeat_after_compaction_is_no_duplicate(spark):
    ix = lines(spark, [call("a", blocks=[use("1", "Read", file_path="/f")]), result("1", "same"), BOUNDARY, call("b", blocks=[use("2", "Read", file_path="/f")]), result("2", "same")])
    assert floor.judged_results(al.tool_uses(ix)).where("category IS NOT NULL").count() == 0


def test_instruction_rule_and_snapshot(spark):
    docs = [prompt("one"), call("a"), prompt("<local>no</local>"), prompt("meta", isMeta=True), prompt("<system-reminder>x</system-reminder>"), prompt("two"), call("b"), prompt("three"), call("c")]
    ix = lines(spark, docs)
    assert [(r["instr"], r["start_k"]) for r in al.instructions(ix).orderBy("instr").collect()] == [(1, 0), (2, 1), (3, 2)]
    cut = al.snapshot(ix, spark.createDataFrame([("s", 2, None)], "session_id string, max_instr int, max_calls int"))
    assert al.calls(cut).count() == 2


def trace(spark, contexts, outputs, segs, compact=()):
    """segs: (id, kind, birth, tokens, terms)."""
    ep = lambda k: sum(1 for c in compact if c <= k)
    calls = spark.createDataFrame([("s", k, c, ep(k)) for k, c in enumerate(contexts)], "session_id string, k bigint, context bigint, epoch bigint")
    terms = spark.createDataFrame([("s", k, t) for k, o in enumerate(outputs) for t in o], "session_id string, k bigint, term string")
    s = spark.createDataFrame([("s", i, kind, float(n), b, list(t)) for i, kind, b, n, t in segs], "session_id string, seg_id bigint, kind string, tokens double, birth bigint, terms array<string>")
    return s, terms, calls


def test_needed_picks_the_cheaper_side_of_each_gap(spark):
    segs, terms, calls = trace(spark, [100] * 10, [[], [], ["aaaaaa"], [], [], [], [], [], [], ["aaaaaa"]], [(1, "user_prompt", 1, 100, ["aaaaaa"])])
    wins, refs = bound.link(segs, terms, calls)
    assert [r["k"] for r in refs.orderBy("k").collect()] == [1, 2, 9]
    n = bound.segment_needs(wins, refs, (0.0, 200.0, math.inf)).first()
    assert (n["need_P0"], n["need_P200"], n["need_Pinf"]) == (300, 500, 900)


def test_links_do_not_cross_a_compaction(spark):
    segs, terms, calls = trace(spark, [100] * 5, [[], [], [], [], ["bbbbbb"]], [(1, "tool_result", 1, 10, ["bbbbbb"])], compact=(3,))
    wins, refs = bound.link(segs, terms, calls)
    assert wins.first()["end"] == 3 and [r["k"] for r in refs.collect()] == [1]


def test_mirror_placebo(spark):
    outs = [["cccccc"] if k in (12, 14, 16) else [] for k in range(20)]
    keep = bound.link(*trace(spark, [1] * 20, outs, [(1, "user_prompt", 10, 5, ["cccccc"])]), common_frac=0.5, placebo="mirror")[1]
    assert [r["k"] for r in keep.orderBy("k").collect()] == [10, 12, 14, 16]
    outs = [["cccccc"] if k in (4, 6, 8, 12, 14, 16) else [] for k in range(20)]
    drop = bound.link(*trace(spark, [1] * 20, outs, [(1, "user_prompt", 10, 5, ["cccccc"])]), common_frac=5.0, placebo="mirror")[1]
    assert [r["k"] for r in drop.collect()] == [10]
    with pytest.raises(ValueError):
        bound.link(*trace(spark, [1], [[]], [(1, "x", 0, 1, [])]), placebo="other")


def test_calibrated_segments_add_up_to_the_context(spark):
    contexts = [10_000, 14_000, 18_500, 12_000, 15_000]
    segs, terms, calls = trace(spark, contexts, [[] for _ in contexts], [(i, "tool_result", i, 2500, []) for i in range(1, 5)], compact=(3,))
    scaled, _ = bound.calibrate(segs, calls)
    w = bound.windows(scaled, calls).collect()
    for k, ctx in enumerate(contexts):
        assert abs(10_000 + sum(s["tokens"] for s in w if s["birth"] <= k < s["end"]) - ctx) < 1e-6


def brute_policy(segs, refs, contexts, family, n, penalty=1000.0, stub=20.0):
    measured = sum(contexts)
    cost = measured - sum(s["tokens"] * (s["end"] - s["birth"]) for s in segs)
    used = missed = 0
    for s in segs:
        need, last = refs[s["seg_id"]], s["birth"]
        cost += s["tokens"]
        for k in range(s["birth"] + 1, s["end"]):
            keep = k - s["birth"] < n if family == "window" else k - last <= n
            if k in need:
                used, last = used + 1, k
                cost += s["tokens"] + (0 if keep else penalty)
                missed += not keep
            elif keep:
                cost += s["tokens"]
            elif family == "pointer":
                cost += min(stub, s["tokens"])
    return cost, used, missed


def test_policies_equal_a_call_by_call_replay(spark):
    import random

    rng = random.Random(1)
    outs = [[f"term{rng.randrange(12):04d}"] for _ in range(40)]
    segs, terms, calls = trace(spark, [5000] * 40, outs, [(i, "tool_result", rng.randrange(35), rng.randrange(5, 400), [f"term{rng.randrange(12):04d}"]) for i in range(30)])
    wins, refs = bound.link(segs, terms, calls, common_frac=0.5)
    got = {(r["family"], r["n"]): (r["cost"], r["refs"], r["misses"]) for r in policy.simulate(bound.segment_needs(wins, refs), refs, calls).collect()}
    w = [r for r in wins.collect() if r["end"] > r["birth"]]
    by = {}
    for r in refs.collect():
        by.setdefault(r["seg_id"], set()).add(r["k"])
    for (fam, n), (cost, used, missed) in got.items():
        c, u, m = brute_policy(w, by, [5000] * 40, fam, n)
        assert abs(c - cost) < 1e-6 and (u, m) == (used, missed), (fam, n)


def series(spark, ctx, starts=()):
    rows = [("s", k, c, sum(1 for s in starts if s <= k)) for k, c in enumerate(ctx)]
    return whatif.series(spark.createDataFrame(rows, "session_id string, k bigint, context bigint, instr bigint"))


def py_replay(ctx, starts, sc, base, post):
    bounds = sorted({0, *[s for s in starts if s < len(ctx)]})
    ceiling = max(ctx) if sc.ceiling is None else sc.ceiling
    post = sc.post if sc.post is not None else base + sc.summary if sc.capped else post
    total = restarts = comps = 0
    s = peak = ctx[0]
    for k, x in enumerate(ctx):
        if k:
            d = x - ctx[k - 1]
            cont = s + d if d >= 0 else (min(s, x) if s >= 0.9 * ctx[k - 1] else s)
            nth = bounds.index(k) if k in bounds else 0
            due = nth > 0 and ((sc.every and nth % sc.every == 0) or (sc.threshold is not None and s > sc.threshold))
            begun = base + sc.summary + max(0, d)
            if due and begun < cont:
                s, restarts = begun, restarts + 1
            elif d >= 0 and cont > ceiling and post + min(d, ceiling) < cont:
                total, comps, s = total + cont, comps + 1, post + min(d, ceiling)
            else:
                s = cont
        peak = max(peak, s)
        total += s
    return total, restarts, comps, peak


def test_replays_equal_a_sequential_loop_in_one_block_and_in_many(spark):
    import random

    rng = random.Random(2)
    ctx = [20_000]
    for _ in range(400):
        ctx.append(15_000 if rng.random() < 0.02 else ctx[-1] + rng.randrange(0, 9_000))
    starts = sorted(rng.sample(range(400), 40))
    scs = [whatif.task_scoped(2000), whatif.Scenario("e3", every=3), whatif.Scenario("t", threshold=60_000), whatif.Scenario("c", ceiling=90_000, capped=True), whatif.Scenario("p", ceiling=70_000, post=30_000, capped=True)]
    post = series(spark, ctx, starts).first()["post"]
    for block in (20_000, 37):
        got = {r["scenario"]: (r["input"], r["restarts"], r["compactions"], r["peak"]) for r in whatif.replay(series(spark, ctx, starts), scs, block).collect()}
        for sc in scs:
            assert got[sc.name] == py_replay(ctx, starts, sc, ctx[0], post), (block, sc.name)


def test_discarded_and_stale(spark):
    w = spark.createDataFrame([("s", "/a", 1, 300, 0), ("s", "/a", 2, 50, 1), ("s", "/b", 1, 9, 2)], "session_id string, path string, instr bigint, tokens bigint, o int")
    assert [tuple(r) for r in rules.discarded_output(w, ["o"]).collect()] == [("s", 1, 300)]


def test_over_exploration(spark):
    long = " ".join(f"identifier_{i}" for i in range(200))
    docs = [prompt("go"), call("a", blocks=[use("1", "Grep", pattern="p")]), result("1", long), call("b", blocks=[{"type": "text", "text": "identifier_1 and identifier_2"}]),
            call("c", blocks=[use("2", "Bash", command="cat /etc/x")]), result("2", long.replace("identifier", "otherthing")), call("d", blocks=[{"type": "text", "text": "done"}])]
    ix = lines(spark, docs)
    r = rules.over_exploration(rules.exploration(al.tool_uses(ix)), al.output_terms(ix)).first()
    assert r["w8"] == text_tokens(long.replace("identifier", "otherthing")) and r["w8_explore"] == r["w8"] + text_tokens(long)


def text_tokens(t):
    return max(1, math.ceil(len(" ".join(t.split())) / 4))


def test_kappa(spark):
    pairs = [("x", "yes", "yes")] * 4 + [("x", "no", "no")] * 3 + [("x", "yes", "no")] * 2 + [("x", "no", "yes")]
    k = labels.kappa(spark.createDataFrame(pairs, "category string, a string, b string"), ["category"]).first()
    assert k["n"] == 10 and abs(k["kappa"] - 0.4) < 1e-9
    one = labels.kappa(spark.createDataFrame([("x", "yes", "yes")], "category string, a string, b string"), ["category"]).first()
    assert one["kappa"] is None


def test_quality_and_wilson(spark):
    a = spark.createDataFrame([("hit", True)] * 3 + [("hit", False)] + [("miss", True)] + [("miss", False)] * 3, "stratum string, needed boolean")
    pop = spark.createDataFrame([("hit", 100), ("miss", 900)], "stratum string, size bigint")
    q = policy.detector_quality(a, pop).first()
    assert (q["precision_p"], q["missed_p"]) == (75.0, 25.0) and abs(q["recall_estimate"] - 25.0) < 1e-9
    w = spark.range(1).select(numbers.wilson(F.lit(8), F.lit(10)).alias("w")).first()["w"]
    assert w["p"] == 0.8 and 0.49 < w["low"] < 0.5 and 0.94 < w["high"] < 0.95


def test_bootstrap_covers_the_median_and_repeats(spark):
    df = spark.createDataFrame([("g", float(i)) for i in range(101)], "g string, v double")
    a = policy.bootstrap_median(df, ["g"], "v", reps=2000).first()
    assert a["ci_low"] < 50 < a["ci_high"] and 12 < a["ci_high"] - a["ci_low"] < 32
    assert policy.bootstrap_median(df.repartition(7), ["g"], "v", reps=2000).first() == a


def test_tokens_languages_words_and_hashes(spark):
    df = spark.createDataFrame([("",), ("abcd efgh",), ("안녕하세요 hi",), ("  ",)], "t string")
    assert [r[0] for r in df.select(text.estimate_tokens("t")).collect()] == [0, 3, 6, 1]
    w = spark.createDataFrame([("The parser's config.yaml and 데이터에서는 UI 또는 a@b.co",)], "t string").select(text.content_words("t")).first()[0]
    assert w == ["parser", "config.yaml", "데이터", "ui"]
    lang = spark.createDataFrame([("한국어 text",), ("ひらがな",), ("123",)], "t string").select(text.detect_language("t")).collect()
    assert [r[0] for r in lang] == ["ko", "ja", "und"]

    def fnv(b, h):
        for x in b:
            h = ((h ^ x) * 0x01000193) & 0xFFFFFFFF
        return h

    got = spark.createDataFrame([("grüße",)], "t string").select(text.hash64("t")).first()[0]
    want = (fnv("grüße".encode(), 0x050C5D1F) << 32) | fnv("grüße".encode(), 0x811C9DC5)
    assert got % 2**64 == want
    fp = spark.createDataFrame([("alpha beta gamma",), ("alpha beta gamma",), ("delta epsilon zeta",)], "t string") \
        .select(text.simhash64(text.content_words("t"), text.fallback_tokens("t"), b"k").alias("f")).collect()
    assert fp[0] == fp[1] != fp[2]


def test_retries_find_the_latest_near_copy(spark):
    base = "please sort customer invoices quarterly region ledger totals amounts currency"
    rows = [(1, 0, "user", base), (1, 2, "user", "unrelated weather forecast tomorrow morning"), (1, 4, "user", base + " again"), (1, 6, "user", base), (2, 0, "user", base)]
    df = chat.turn_words(spark.createDataFrame(rows, "conv_id bigint, idx bigint, role string, text string"))
    got = {(r["conv_id"], r["idx"]): r["retry_of"] for r in chat.retries(chat.fingerprints(df)).collect()}
    assert got == {(1, 4): 0, (1, 6): 4}


def test_threads_pivot_and_return(spark):
    rows = [(1, 0, "user", "instruct", 20, None, ["parser"], ["parser", "lexer"]), (1, 1, "assistant", "answer", 50, None, ["parser"], ["grammar"]),
            (1, 2, "user", "ask", 20, None, ["grammar"], ["grammar", "tokens"]), (1, 3, "user", "ask", 20, None, ["holiday"], ["holiday", "beach"]),
            (1, 4, "user", "ask", 20, None, ["lexer"], ["lexer"]), (1, 5, "user", "ack", 2, None, [], []), (1, 6, "user", "retry", 20, 3, ["holiday"], ["holiday"])]
    df = spark.createDataFrame(rows, "conv_id bigint, idx bigint, role string, intent string, tokens bigint, retry_of bigint, topics array<string>, cues array<string>")
    ex = lambda c: df.select("conv_id", "idx", F.explode(c).alias("word"))
    got = {r["idx"]: (r["branch"], r["depth"], r["edge"], r["edge_to"]) for r in chat.threads(df, ex("topics"), ex("cues")).collect()}
    assert got == {0: (0, 0, None, None), 1: (0, 0, "ANSWERS", 0), 2: (0, 1, "DEEPENS", 0), 3: (1, 0, "PIVOTS", 2), 4: (0, 2, "RETURNS", 2), 5: (0, 2, "REVISITS", 4), 6: (1, 0, "RETRIES", 3)}


def test_error_results_without_their_use_are_failures(spark, tmp_path):
    """An orphan is compared with nothing; an error among orphans is W2, with or without an id."""
    def result(i, error, text="same"):
        return {"type": "user", "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": i, "is_error": error, "content": text}]}}

    use = {"type": "assistant", "message": {"id": "m1", "usage": {"input_tokens": 5}, "content": [{"type": "tool_use", "id": "u1", "name": "Bash", "input": {"command": "x"}}]}}
    lines = [use, result("u1", True), result("gone", True), result("gone", True), result(None, True, "abcdefgh"), result("gone2", False)]
    path = tmp_path / "s.jsonl"
    path.write_text("\n".join(json.dumps(x) for x in lines))
    ix = al.index_lines(al.parse_lines(al.read_agent_logs(spark, [str(tmp_path)])))
    got = floor.judged_results(al.tool_uses(ix), orphans=al.orphan_results(ix)).collect()
    assert sorted(((r.use_id or "", r.category) for r in got), key=str) == [("", "W2"), ("gone", "W2"), ("gone", "W2"), ("gone2", None), ("u1", "W2")]
    total = floor.floor(al.calls(ix), floor.judged_results(al.tool_uses(ix), orphans=al.orphan_results(ix)), floor.churn(al.calls(ix), al.ORDER)).first()
    assert (total.w2_count, total.w2_tokens) == (4, 1 + 1 + 1 + 2)


def test_tool_inputs_are_counted_as_written(spark):
    """Blanks stand behind commas and colons, but not inside strings, whatever their escapes."""
    inputs = [{"a": "longer words here", "x": 1}, {"k": 'say "a,b:c" \\', "l": [1, 2, {"m": None}]}, {"e": "\\\\", "f": "a,b"}, {"n": "line\nbreak, tab\t:"}, {}]
    for x in inputs:
        text = json.dumps(x, ensure_ascii=False, sort_keys=True)
        df = spark.createDataFrame([(json.dumps(x),)], "j string").select(al.spaced_json(F.to_json(F.parse_json("j"))).alias("t"))
        assert df.first().t == text
