"""Driver contract smoke test."""

import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert "congestion_impact_score" in df.columns and "tier" in df.columns
    assert len({r.hex_id for r in rows}) == len(rows)
    scores = [r.congestion_impact_score for r in rows]
    assert scores == sorted(scores, reverse=True)
