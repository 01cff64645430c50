"""Physical-plan guards for the scale claims in the README."""

import re

import pytest

from pyspark.sql.classic.dataframe import DataFrame

from curbscope.operators import patrol as P
from curbscope.operators.rollup import cell_rollup
from curbscope.plans import registry as R
from tests.conftest import SF001

FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython",
             "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF"]
SIDE_EFFECTS = {"hotspot_export", "hotspot_export_parquet", "stream_hex_counts", "scan_violations_csv",
                "scan_first_rows", "cached_build"}
#: KMeans runs while these are built; their record side is that of ``percentile_scores``.
FITS = {"tier_hotspots", "tier_invariants", "hotspot_table"}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(R.QUERIES) - SIDE_EFFECTS - FITS))
def test_no_cross_joins_or_python(spark, monkeypatch, name):
    """The whole plan, down to the file scan: checkpoints, behind which a
    plan starts anew, are left out."""
    monkeypatch.setattr(DataFrame, "checkpoint", lambda self, *a, **k: self)
    plan = plan_of(R.QUERIES[name](spark, SF001))
    assert "FileScan parquet" in plan, name
    for op in FORBIDDEN:
        assert op not in plan, (name, op)


@pytest.mark.parametrize("name", ["map_center", "kpis", "cis_scores"])
def test_the_cell_table_is_not_sorted(spark, name):
    plan = plan_of(R.QUERIES[name](spark, SF001))
    assert "rangepartitioning" not in plan


def test_scan_prunes_columns(spark):
    plan = plan_of(R.records(spark, SF001))
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", plan)
    assert schemas == ["struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string>"]


def test_rollup_aggregates_before_the_shuffle(spark):
    plan = plan_of(cell_rollup(R.records(spark, SF001)))
    first_exchange = plan.index("Exchange hashpartitioning(hex_id")
    assert "partial_count" in plan[first_exchange:]     # partial aggregate below it


def test_patrol_by_station_limits_before_shuffle(spark):
    plan = plan_of(P.patrol_by_station(R.hot(spark, SF001)))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_the_rollup_is_dealt_out_by_cell_once(spark, monkeypatch):
    """Features, weekly trend and tag map aggregate and join the written
    rollup where its rows lie: no exchange by cell after it."""
    from curbscope.operators.features import hotspot_features, tag_breakdown_map
    from curbscope.operators.trend import growth_trend
    from curbscope.operators.busy import weekly_counts
    from curbscope.plans import build as B

    rollup = R.rollup(spark, SF001)
    prev = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for one in (hotspot_features(rollup), growth_trend(weekly_counts(rollup)), tag_breakdown_map(rollup)):
            plan = plan_of(one)
            assert "Bucketed: true" in plan and "hashpartitioning(hex_id" not in plan
        monkeypatch.setattr(DataFrame, "checkpoint", lambda self, *a, **k: self)
        plan = plan_of(B.scored_cells(rollup))
        assert "SortMergeJoin [hex_id" in plan and "hashpartitioning(hex_id" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", prev)


def test_bucketed_table_outlives_its_name(spark):
    from curbscope.plans.tables import bucketed

    before = {t.name for t in spark.catalog.listTables()}
    rows = spark.range(100).selectExpr("id", "cast(id % 7 as string) as `key`")
    out = bucketed(rows, "key", buckets=3)
    assert {t.name for t in spark.catalog.listTables()} == before
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, rows.collect()))
    assert out.groupBy("key").count().collect() and "Exchange" not in plan_of(out.groupBy("key").count())
