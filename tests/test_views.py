"""Dashboard views, display formats and the empty-input path."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from curbscope import schema as S
from curbscope.operators import views as V
from curbscope.operators.clean import clean_violations
from curbscope.plans import registry as R
from curbscope.plans.build import build_hotspot_table
from curbscope.sources.events import violations_raw
from tests.conftest import SF001


@pytest.fixture(scope="module")
def built(spark):
    return R.build(spark, SF001)


def test_view_filters(built):
    h = built.hotspots
    assert V.hotspot_view(h, []).count() == 0
    assert V.hotspot_view(h, None).count() == h.count()
    one = h.select("dominant_station").first()[0]
    v = V.hotspot_view(h, None, [one])
    assert v.count() == h.filter(F.col("dominant_station") == one).count()
    cis = [r.congestion_impact_score for r in v.collect()]
    assert cis == sorted(cis, reverse=True)


def test_options_labels_and_lookup(built):
    opts = V.hotspot_options(built.hotspots, 5).collect()
    assert len(opts) == 5
    label = opts[0].label
    hex_id = built.hotspots.sparkSession.createDataFrame([(label,)], "l string") \
        .select(V.hex_of_label(F.col("l")).alias("h")).first().h
    assert hex_id == opts[0].hex_id
    assert V.hotspot_lookup(built.hotspots, hex_id).count() == 1


def test_map_layer_and_center(spark, built):
    layer = {r.tier: (r.color_r, r.color_g, r.color_b, r.color_a)
             for r in V.map_layer(built.hotspots).collect()}
    for tier, rgba in layer.items():
        assert list(rgba) == S.TIER_COLORS[tier]
    empty = V.hotspot_view(built.hotspots, [])
    c = V.map_center(empty).first()
    assert (c.center_lat, c.center_lon) == S.DEFAULT_CENTER


def test_report_display(spark):
    report = spark.createDataFrame(
        [("9:1:2", "PS-1", 12, 61.25, "High", 42.35, 0.875, 12345, 4505925, 0.5, 0.125, 1.0, -0.031,
          "x")],
        "hex_id string, station string, violations long, cis double, tier string, "
        "lane_loss_pct double, queue_km double, daily_cost_inr long, annual_cost_inr long, "
        "pct_at_junction double, pct_busy_hours double, persistence double, "
        "weekly_growth double, recommended_action string")
    r = V.priority_report_display(report).first()
    assert r.daily_cost_inr == "12,345" and r.annual_cost_inr == "4,505,925"
    assert r.queue_km == "0.88" and r.pct_at_junction == "50.0%"
    assert r.weekly_growth == "-3.1%" and r.persistence == "100.0%"
    assert r.cis == "61.2" and r.pct_busy_hours == "12.5%"     # half-even before formatting


def test_kpi_busy_label(spark):
    busy = spark.createDataFrame([(9, 10, 0.3), (8, 12, 0.2)], "hour int, n long, cum_share double")
    assert V.busy_hours_label(busy).first().busy_hours == "08h, 09h"


def test_empty_input(spark):
    raw = violations_raw(spark, SF001).filter(F.lit(False))
    b = build_hotspot_table(clean_violations(raw), tiering="kmeans")
    assert b.hotspots.count() == 0 and b.busy.count() == 0
    k = V.kpis(b.hotspots, b.rollup, b.busy).first()
    assert k.violations == 0 and k.hotspots == 0 and k.avg_cis is None and k.busy_hours == ""
    assert V.weekday_hour_pivot(b.rollup).count() == 0


def test_profile_from_the_histogram(spark):
    """Against pandas, with nulls, ties and a single value; records are
    counted before anything is exploded."""
    import numpy as np
    import pandas as pd

    from curbscope.operators.views import profile_clean
    from tests.test_plans import plan_of

    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"severity": rng.choice([1.0, 1.5, 3.0], 501), "hour": rng.integers(0, 24, 501),
                        "weekday": 3, "at_junction": rng.random(501) < 0.3})
    df = spark.createDataFrame(pdf).withColumn("hour", F.when(F.col("hour") != 5, F.col("hour")))
    out = profile_clean(df)
    got = {r["column"]: r for r in out.collect()}
    pdf["hour"] = pdf["hour"].where(pdf["hour"] != 5)
    for c in pdf:
        want = pdf[c].astype(float).describe()
        r = got[c]
        assert r["count"] == want["count"]
        for a, b in (("mean", "mean"), ("std", "std"), ("min", "min"), ("p25", "25%"), ("p50", "50%"), ("p75", "75%"), ("max", "max")):
            assert r[a] == pytest.approx(want[b]), (c, a)
    lines = plan_of(out).splitlines()
    explode = next(i for i, x in enumerate(lines) if "Generate explode" in x)
    assert any("HashAggregate" in x for x in lines[explode + 1:])
    one = profile_clean(df.limit(1)).collect()
    assert {r["count"] for r in one} <= {0, 1} and all(r["std"] is None for r in one)
    assert profile_clean(df.limit(0)).count() == 0
