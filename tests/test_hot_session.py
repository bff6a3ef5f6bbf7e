"""A session cut into blocks gives the same silver tables and reports as an uncut one."""

from pyspark.sql import functions as F

from sparkmeter import scale
from sparkmeter.operators import audit, floor, survey
from sparkmeter.plans import log_queries
from sparkmeter.sources import agent_logs as al

SF = "/root/testdata/sf0.001"


def reports(raw):
    ix = al.index_lines(al.parse_lines(raw))
    calls, uses = al.calls(ix), al.tool_uses(ix)
    drop = lambda df, *cols: {tuple(str(v) for v in r) for r in df.select(*cols).collect()}
    judged = floor.judged_results(uses)
    return {
        "calls": drop(calls, "session_id", "k", "epoch", "instr", "context"),
        "uses": drop(uses, "session_id", "use_id", "k", "result_tokens", "is_error"),
        "judged": drop(judged, "session_id", "use_id", "category"),
        "churn": drop(floor.churn(calls, al.ORDER), "session_id", "k", "tokens", "cause"),
        "audit": drop(audit.audit(calls, uses), "session_id", "dup_count", "failed_count", "carried_tokens", "peak_context"),
        "parts": drop(survey.decompose(calls, order=al.ORDER), "session_id", "fixed", "carried", "current"),
    }


def test_blocks_do_not_change_any_report(spark):
    raw = log_queries.raw_lines(spark, SF).withColumn("session_id", F.when(F.col("session_id").cast("int") % 3 == 0, F.lit("hot")).otherwise(F.col("session_id")))
    # several users merged into one session: place lines by time, ids stay unique
    raw = scale.materialize(raw)
    cut = scale.with_blocks(raw, ["session_id"], "at", min_rows=150)
    assert scale.BLOCK in cut.columns and cut.where("session_id = 'hot'").select(scale.BLOCK).distinct().count() > 3
    plain, blocked = reports(raw), reports(scale.materialize(cut))
    for name in plain:
        assert plain[name] == blocked[name], name
