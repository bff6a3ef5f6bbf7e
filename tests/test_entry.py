"""Contract of the registered queries."""

import __spark_entry__ as entry


def test_every_oracle_has_a_query_and_the_flagship_runs(spark):
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 150
    assert entry.entry(spark).count() > 0


def test_samples_match_their_sql(spark):
    import oracle_check as oc

    sf = "/root/testdata/sf0.001"
    con = oc.connect(sf)
    for name in ("conversation_receipts", "session_audit", "corpus_floor", "context_bound", "ledger_summary", "reasked_prompts"):
        assert oc.compare(entry.queries()[name](spark, sf), con, entry.oracle_sql()[name]) is None, name
