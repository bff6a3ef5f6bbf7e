"""File readers on small synthetic files, and the contribution rules."""

import json

import pytest
from pyspark.sql import functions as F

from sparkmeter.operators import contrib
from sparkmeter.sources import agent_logs as al
from sparkmeter.sources import chats, event_pages, sinks


def test_transcripts_with_subagents_and_order(spark, tmp_path):
    def line(mid, ts=None, side=False):
        d = {"type": "assistant", "isSidechain": side, "agentId": "g" if side else None, "message": {"id": mid, "usage": {"input_tokens": 10}, "content": []}}
        return json.dumps({**d, "timestamp": ts} if ts else d)

    (tmp_path / "s1.jsonl").write_text("\n".join([line("a", "2026-01-01T00:00:00Z"), line("b"), line("c", "2026-01-01T00:10:00Z"), "{bad"]))
    sub = tmp_path / "s1" / "subagents"
    sub.mkdir(parents=True)
    (sub / "x.jsonl").write_text(line("d", "2026-01-01T00:05:00Z", True))
    (tmp_path / "s2.jsonl").write_text("\n".join(line(f"m{i}") for i in range(500)))
    raw = al.read_agent_logs(spark, [str(tmp_path)])
    ix = al.index_lines(al.parse_lines(raw))
    c = al.calls(ix)
    assert {(r["session_id"].rsplit("/", 1)[1], r["ctx_key"]): r["n"] for r in c.groupBy("session_id", "ctx_key").agg(F.count("*").alias("n")).collect()} == \
        {("s1", "main"): 3, ("s1", "side:g"): 1, ("s2", "main"): 500}
    order = [r["msg_key"] for r in ix.where("session_id like '%s1'").orderBy(*al.ORDER).collect()]
    assert order == ["a", "b", "d", "c"]
    later = [r["msg_key"] for r in ix.where("session_id like '%s2'").orderBy(*al.ORDER).collect()]
    assert later == [f"m{i}" for i in range(500)]
    assert al.read_agent_logs(spark, [str(tmp_path)], since="2999-01-01T00:00:00").count() == 0


def test_event_pages_both_wrappers(spark):
    ev = lambda u, t, n: {"assistant": {"uuid": u, "timestamp": t, "message": {"id": u, "usage": {"input_tokens": n}, "content": []}}, "created_at": t}
    page = json.dumps({"ccr": {"data": [ev("a", "2026-01-01T00:00:07.840077Z", 1), ev("b", "2026-01-01T00:00:08.3Z", 2)]}})
    second = json.dumps([{"type": "text", "text": "x " + json.dumps({"ccr": {"data": [ev("a", "2026-01-01T00:00:07.840077Z", 5), ev("c", "bad time", 3)]}}) + " tail }"}])
    pages = spark.createDataFrame([("s", "1", page), ("s", "2", second)], "session_id string, page string, raw string")
    c = al.calls(al.index_lines(al.parse_lines(event_pages.event_lines(pages)))).orderBy("k").collect()
    assert [r["context"] for r in c] == [5, 2, 3]  # last version wins, unreadable times last


def test_export_shapes(spark):
    tree = {"current_node": "3", "mapping": {"1": {"message": None, "parent": None}, "2": {"message": {"author": {"role": "user"}, "content": {"parts": ["hi"]}}, "parent": "1"},
                                              "3": {"message": {"author": {"role": "assistant"}, "content": {"parts": ["yo", ""]}}, "parent": "2"}, "4": {"message": {"author": {"role": "user"}, "content": {"parts": ["other"]}}, "parent": "1"}}}
    docs = [tree, [{"role": "user", "content": "a"}, {"role": "user", "content": [{"type": "text", "text": "b"}, {"type": "image"}]}], {"data": {"chat_messages": [{"sender": "human", "text": "q"}, {"sender": "assistant", "content": [{"text": "r"}]}]}, "zzz": {"messages": [{"role": "user", "content": "never"}]}},
            [{"messages": [{"role": "user", "content": "one"}]}, {"contents": [{"role": "user", "parts": [{"text": "two"}]}]}], {"messages": [{"role": "assistant", "content": "alone"}]}]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "doc_id int, j string").select("doc_id", F.try_parse_json("j").alias("v"))
    got = [(r["doc_id"], r["source"], r["idx"], r["role"], r["text"]) for r in chats.parse_documents(df).orderBy("doc_id", "conv_no", "idx").collect()]
    assert got == [(0, "chatgpt", 0, "user", "hi"), (0, "chatgpt", 1, "assistant", "yo"), (1, "openai-messages", 0, "user", "a\n\nb"), (2, "claude", 0, "user", "q"), (2, "claude", 1, "assistant", "r"),
                   (3, "openai-messages", 0, "user", "one"), (3, "gemini", 0, "user", "two")]


def test_large_and_deep_exports_and_unreadable_files(spark, tmp_path):
    turns = lambda n: [{"role": "user" if i % 2 == 0 else "assistant", "content": f"{i} " + "x" * 20_000} for i in range(n)]
    content = "deep"
    for _ in range(12):
        content = [{"type": "text", "text": {"parts": [content]}}]
    nested = {"messages": [{"role": "user", "content": content}]}
    for _ in range(9):
        nested = {"props": [nested]}
    (tmp_path / "large.json").write_text(json.dumps([{"messages": turns(1000)}, {"messages": turns(2)}]))
    (tmp_path / "nested.json").write_text(json.dumps(nested))
    (tmp_path / "bad.json").write_text('{"messages": [')
    got = chats.read_chat_exports(spark, [str(tmp_path)]).withColumn("file", F.regexp_extract("doc_id", r"([a-z]+)\.json", 1))
    assert {(r["file"], r["conv_no"]): r["n"] for r in got.where("error IS NULL").groupBy("file", "conv_no").agg(F.count("*").alias("n")).collect()} == \
        {("large", "000000000"): 1000, ("large", "000000001"): 2, ("nested", "000000000"): 1}
    assert [r["text"] for r in got.where("file = 'nested'").collect()] == ["deep"]
    assert [(r["file"], r["text"]) for r in got.where("error IS NOT NULL").collect()] == [("bad", None)]
    page = spark.createDataFrame([("p", f'<script type="application/json">{json.dumps({"messages": turns(900)})}</script>'), ("q", '<script type="application/json">{no</script>')], "doc_id string, html string")
    assert chats.parse_pages(page).count() == 900 and [(r["doc_id"], r["block"]) for r in chats.unreadable_blocks(page).collect()] == [("q", 0)]


def test_role_marked_text_and_sql_functions(spark):
    from sparkmeter.functions.register import register_functions

    t = "**User**: hello\nthere\n\n## Assistant\nhi: ok\n질문: 또\nAI： yes"
    got = [(r["role"], r["text"]) for r in chats.role_marked(spark.createDataFrame([(1, t)], "doc_id int, text string")).orderBy("idx").collect()]
    assert got == [("user", "hello\nthere"), ("assistant", "hi: ok"), ("user", "또"), ("assistant", "yes")]
    register_functions(spark)
    r = spark.sql("select estimate_tokens('abcd efgh') a, classify_user_turn('Thanks!', 2, false, false, false) b, classify_reply('Which one?', 3, false) c, scrub_pii('x a@b.co') d").first()
    assert (r["a"], r["b"], r["c"], r["d"].strip()) == (3, "ack", "followup_question", "x")


def test_share_page(spark):
    html = '<main><div data-message-author-role="user"><p>What&#39;s up</p></div><p data-message-author-role="assistant">Fine &amp; <b>well</b></p></main>'
    got = [(r["role"], r["text"]) for r in chats.parse_pages(spark.createDataFrame([("p", html)], "doc_id string, html string")).orderBy("idx").collect()]
    assert got[0][1].startswith("What's up") and got[1] == ("assistant", "Fine & well")


def test_dataset_digest_ignores_order_and_writes(spark, tmp_path):
    df = spark.range(100).withColumn("v", F.col("id") * 2)
    assert sinks.dataset_digest(df).first() == sinks.dataset_digest(df.repartition(5).select("v", "id")).first()
    sinks.write_dataset(df, str(tmp_path / "d"), "u1")
    assert spark.read.parquet(str(tmp_path / "d")).where("subject = 'u1'").count() == 100


TURNS = [["u", "ask", 0, 0, 10, 0], ["a", "answer", 0, 0, 20, 0]]
METRICS = {"user_turns": 1, "assistant_turns": 1, "visible_tokens": 30, "billed_input_tokens": 10, "billed_output_tokens": 20, "compute_units": 22, "optimized_compute_units": 22,
           "one_shot_compute_units": 22, "savings_pct": 0.0, "one_shot_savings_pct": 0.0, "max_depth": 0, "branches": 1}


def skeleton(**data):
    d = {"source": "claude", "language": "en", "metrics": METRICS, "waste": {"ack_units": 0, "superseded_units": 0, "offtopic_context_tokens": 0}, "turns": TURNS, "edges": {"NEXT": 1}, **data}
    return {"schema": contrib.SCHEMA, "kind": "skeleton", "client": "cli", "version": "0.1.0", "data": d}


CASES = [
    (skeleton(), True), (skeleton(labels=["sql", "spark"]), True), (skeleton(labels=["a_b"]), False), (skeleton(labels=["x", "x"]), False), (skeleton(labels=["ok\n"]), False), (skeleton(source="me"), False),
    (skeleton(text="secret"), False), (skeleton(turns=[]), False), (skeleton(turns=[["u", "ask", 0, 0, 10, True]]), False), (skeleton(turns=TURNS[:1]), False), (skeleton(edges={"LIKES": 1}), False),
    (skeleton(metrics={**METRICS, "user_turns": "1"}), False), (skeleton(metrics={**METRICS, "optimized_compute_units": 99}), False), (skeleton(metrics={**METRICS, "savings_pct": 101}), False),
    ({**skeleton(), "extra": 1}, False), ({**skeleton(), "schema": "other"}, False), ({**skeleton(), "version": "1.0"}, False), ({**skeleton(), "kind": "blob"}, False),
]
ROW = {"day": "2026-01-01", "provider": "openai", "model": "m", "action": "forwarded", **{k: 1 for k in contrib.LEDGER_NUMS}}


def ledger(row):
    return {"schema": contrib.SCHEMA, "kind": "ledger", "client": "web", "version": "1.2.3", "data": {"rows": [row]}}


CASES += [(ledger(ROW), True), (ledger({**ROW, "day": "yesterday"}), False), (ledger({**ROW, "provider": "me"}), False), (ledger({**ROW, "requests": -1}), False), (ledger({**ROW, "measured_requests": 5}), False), (ledger({**ROW, "prompt": "x"}), False)]
COST = {"count": 1, "tokens": 2, "carried_tokens": 3}
BOUND = {"method": "lexical-v1", "sessions": 1, "api_calls": 5, "measured_input": 100, "pinned_input": 20, "written_tokens": 0, "tokenizer_factor": 1.2,
         "avoidable_pct": {"P0": 40.0, "P1000": 30.0, "P10000": 20.0, "Pinf": 10.0}, "per_session": [[5, 100, 20.0, 40.0, 30.0, 20.0, 10.0]]}


def agent(**over):
    d = {"agent": "claude-code", **{k: 1 for k in contrib.AGENT_NUMS}, "cache_hit_pct": 50.0, "carried_share_pct": 5.5, "tokens": {"input": 1, "cache_read": 2, "cache_write": 3, "output": 4, "processed_input": 6},
         "duplicate_reads": COST, "large_results": COST, "failed_repeats": COST, "by_tool": {"Read": {k: 1 for k in contrib.AGENT_TOOL}}, **over}
    return {"schema": contrib.SCHEMA, "kind": "agent", "client": "cli", "version": "0.1.0", "data": d}


CASES += [(agent(), True), (agent(bound=BOUND), True), (agent(by_tool={"mcp__x": {k: 1 for k in contrib.AGENT_TOOL}}), False), (agent(cache_hit_pct=101), False), (agent(tokens={"input": 1, "cache_read": 2, "cache_write": 3, "output": 4, "processed_input": 7}), False),
          (agent(bound={**BOUND, "avoidable_pct": {"P0": 1.0, "P1000": 30.0, "P10000": 20.0, "Pinf": 10.0}}), False), (agent(bound={**BOUND, "per_session": [[5, 100, 20.0, 10.0, 30.0, 20.0, 10.0]]}), False), (agent(bound={**BOUND, "pinned_input": 500}), False)]


@pytest.mark.parametrize("kind", ["skeleton", "ledger", "agent"])
def test_contribution_rules(spark, kind):
    mine = [(i, json.dumps(p), ok) for i, (p, ok) in enumerate(CASES) if p["kind"] == kind or kind == "skeleton" and p["kind"] == "blob"]
    df = spark.createDataFrame(mine, "id int, payload string, ok boolean")
    got = {r["id"]: r["errors"] for r in contrib.validate(df, kinds=[kind]).collect()}
    wrong = [(i, got[i], p[:80]) for i, p, ok in mine if (not got[i]) != ok]
    assert not wrong


def test_tombstones_and_paging(spark):
    c = spark.createDataFrame([(1, "ann"), (2, "bob")], "id int, author string").withColumn("token_hash", F.sha2(F.concat(F.lit("t"), "id"), 256))
    r = spark.createDataFrame([(1, "eve", "t1"), (2, "eve", "no")], "id int, author string, token string")
    assert [x["id"] for x in contrib.withdraw(c, r).collect()] == [2]
