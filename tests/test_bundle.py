"""One run writes the shared tables once and four results that equal the single analyses."""

import json

import pytest

from sparkmeter.operators import bundle, floor, survey, whatif
from sparkmeter.plans import log_queries as lq
from sparkmeter.sources import agent_logs as al


def rows(df):
    cols = sorted(df.columns)
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(cols).collect()), key=str)


def test_bundle_equals_single_runs(spark, tmp_path):
    out, sf = f"file://{tmp_path}/run", "/root/testdata/sf0.001"
    raw = lq.with_side_lines(spark, sf).unionByName(spark.createDataFrame([("empty", 0, 0, 0, '{"type": "user", "message": {"content": "hi"}}'), ("empty", 1, 0, 1, "no json")], "session_id string, at long, rank long, pos long, value string"))
    manifest = bundle.run(raw, out, "me")
    ix = al.index_lines(al.parse_lines(raw))
    calls, uses = al.calls(ix), al.tool_uses(ix)
    got = {t: spark.read.parquet(f"{out}/gold/{t}") for t in bundle.GOLD}
    single = survey.measure(calls, uses, al.instructions(ix))
    assert rows(got["dataset"].select(*single.columns)) == rows(single)
    assert "empty" not in {r.session_id for r in got["dataset"].collect()}
    assert rows(got["floor"]) == rows(floor.floor(calls, floor.judged_results(uses, orphans=al.orphan_results(ix)), floor.churn(calls, al.ORDER)))
    assert rows(got["whatif"]) == rows(whatif.sweep(calls, order=al.ORDER))
    stored = json.loads(spark.read.text(f"{out}/manifest").first().value)
    assert stored == manifest and stored["label"] == "me" and stored["scan"]["lines"] == raw.count()
    assert {t: v["rows"] for t, v in stored["tables"].items()} == {t: df.count() for t, df in got.items()}
    with pytest.raises(Exception, match="exist"):
        bundle.run(raw, out)
