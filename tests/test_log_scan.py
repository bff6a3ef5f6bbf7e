"""The scan that all log queries share: each line parsed once, odd lines told field by field, bounded tasks, one written index."""

from pyspark.sql import functions as F

from sparkmeter import scale
from sparkmeter.plans import log_queries
from sparkmeter.sources import agent_logs as al

SF = "/root/testdata/sf0.001"
ODD = [
    '{"type":"assistant","message":{"id":7,"usage":{"input_tokens":"12","output_tokens":3.0,"cache_read_input_tokens":[1]},"content":"hi"},"timestamp":"2024-01-01T00:00:00Z"}',
    '{"type":{"a":1},"isSidechain":"true","message":[1,2]}',
    '{"message":{"usage":5,"content":[{"type":"text","text":"x"},3,null]},"isMeta":1,"uuid":"u"}',
    '{"message":{"usage":{},"content":{"a":"b"}},"requestId":"r","timestamp":"never"}',
    "{}", "[]", "null", '"text"', '{"a":1,"a":2}', '{"type": "broken', "", None,
]


def _raw(spark):
    rows = [("s", i, 0, i, v) for i, v in enumerate(ODD)]
    return spark.createDataFrame(rows, "session_id string, at long, rank long, pos long, value string")


def test_odd_lines(spark):
    got = {r.pos: r for r in al.parse_lines(_raw(spark)).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4]
    a, b, c, d, e = (got[i] for i in range(5))
    assert (a.msg_key, a.input, a.output, a.cache_read, a.plain, a.has_usage) == ("7", 12, 3, 0, "hi", True) and a.ts is not None
    assert (b.type, b.is_side, b.has_message, b.has_usage) == ('{"a":1}', True, False, False)
    assert (c.has_message, c.has_usage, c.is_meta, c.msg_key, len(c.blocks), c.plain) == (True, False, True, "u", 3, None)
    assert (d.has_usage, d.msg_key, d.ts, d.blocks, d.plain) == (True, "r", None, None, '{"a":"b"}')
    assert (e.type, e.has_message, e.ctx_key, e.is_instr) == (None, False, "main", False)


def test_a_line_is_parsed_once(spark):
    plan = al.parse_lines(_raw(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1 and "schemaOfVariant" not in plan


def test_tasks_stay_of_one_size(spark):
    lines = al.parse_lines(_raw(spark))
    assert al.index_lines(lines, rows=50_000 * 40).rdd.getNumPartitions() == 40
    assert scale.grouped(lines, ["session_id"], 10) is lines


def test_branches_read_a_written_index(spark):
    files = log_queries.log_tool_uses(spark, SF).inputFiles()
    assert files and all("/index-" in f for f in files)
    assert log_queries.log_tool_uses(spark, SF).where(F.col("has_result")).count() > 0


def test_uses_and_terms_are_written_where_read_again(spark):
    files = [f.rsplit("/", 2)[-2].split("-")[0] for f in log_queries.log_exploration(spark, SF).inputFiles()]
    assert set(files) == {"index", "uses", "terms"}
    assert all("/terms-" in f for f in log_queries.log_term_reach(spark, SF).inputFiles())


def test_births_neither_space_nor_count_texts(spark):
    plan = log_queries.log_segment_births(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "﷐" not in plan
    lines = [
        '{"type":"user","message":{"content":[{"type":"text","text":""},{"type":"text","text":" "},{"type":"text","text":"a b"}]}}',
        '{"type":"assistant","message":{"id":"m","usage":{"input_tokens":5},"content":[{"type":"tool_use","id":"t","name":"Read","input":{"a":"x,y","b":1}},{"type":"tool_use","id":"u","name":"Read"},{"type":"text","text":null}]}}',
        '{"type":"user","message":{"content":[{"type":"tool_result","tool_use_id":"t","content":""},{"type":"tool_result","tool_use_id":"u","content":"ok"}]}}',
    ]
    raw = spark.createDataFrame([("s", i, 0, i, v) for i, v in enumerate(lines)], "session_id string, at long, rank long, pos long, value string")
    got = sorted((r.kind, r.tokens, r.birth) for r in al.segments(al.index_lines(al.parse_lines(raw))).collect())
    assert got == [("tool_input", 5.0, 1), ("tool_result", 1.0, 1), ("user_prompt", 1.0, 0), ("user_prompt", 1.0, 0)]
