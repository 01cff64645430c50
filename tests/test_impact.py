"""Closed-form flow impact, delay cost, rounding and action text."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from curbscope.functions.numeric import clip, rint_round
from curbscope.functions.text import recommended_action
from curbscope.operators.impact import delay_cost, flow_impact
from curbscope import schema as S


def test_rint_round_matches_numpy(spark):
    vals = [0.125, 0.25, 0.35, 1.015, 2.675, 62.45, 12.5, 13.5, -2.5, 84.99999, 0.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    for digits in (0, 1, 2):
        got = [r.y for r in df.select(rint_round(F.col("x"), digits).alias("y")).collect()]
        assert got == [float(np.round(v, digits)) for v in vals]


def reference_impact(avg, jf, pers, count, n_days):
    obstruction = min(avg / 3.0, 1.0)
    k = min(obstruction * (1.0 + jf * 0.5), 0.85)
    cap = float(np.round(k * 100, 1))
    queue = float(np.round(cap / 100 * 2.5 * pers, 2))
    speed = float(np.round(40.0 * (1 - k), 1))
    daily_v = max(count / max(n_days, 1), 0)
    delay = daily_v * 10 * (2.5 / 60) * (avg / 1.5)
    daily = int(np.round(delay * 50.0, 0))
    return cap, queue, speed, daily, daily * 365


IMPACT_CASES = [
    (3.0, 1.0, 1.0, 100, 10),     # capped at 0.85
    (1.5, 0.0, 0.5, 40, 7),       # zero junction
    (2.25, 0.3, 0.33, 17, 29),
    (1.0, 0.5, 0.25, 3, 0),       # n_days 0 -> 1
    (2.0, 1 / 3, 1.0, 1234, 29),
]


@pytest.mark.parametrize("case", IMPACT_CASES)
def test_impact_matches_reference_formulas(spark, case):
    avg, jf, pers, count, n_days = case
    df = spark.createDataFrame([case], "avg_severity double, junction_fraction double, "
                                       "persistence_ratio double, violation_count long, n long")
    r = delay_cost(flow_impact(df), n_days).first()
    assert (r.capacity_loss_pct, r.shockwave_queue_km, r.effective_speed_kmh,
            r.daily_delay_cost_inr, r.annual_delay_cost_inr) == reference_impact(*case)
    assert r.capacity_loss_pct <= 85.0


def test_recommended_action(spark):
    df = spark.createDataFrame([(0.6, 0.1, 0.1, 0.0), (0.5, 0.5, 0.5, 0.06), (0.1, 0.1, 0.1, 0.05)],
                               "j double, b double, p double, g double")
    got = [r.a for r in df.select(recommended_action(F.col("j"), F.col("b"), F.col("p"),
                                                     F.col("g")).alias("a")).collect()]
    assert got[0] == S.ACTION_JUNCTION
    assert got[1] == "; ".join([S.ACTION_JUNCTION, S.ACTION_BUSY, S.ACTION_CHRONIC,
                                S.ACTION_EMERGING])
    assert got[2] == S.ACTION_DEFAULT


def test_clip_keeps_null_and_nan(spark):
    nan = float("nan")
    df = spark.createDataFrame([(None,), (nan,), (-1.0,), (0.4,), (7.0,), (float("inf"),)], "x double")
    both, low, high = clip(F.col("x"), 0, 1), clip(F.col("x"), lower=0), clip(F.col("x"), upper=1)
    got = [tuple(r) for r in df.select(both.alias("b"), low.alias("l"), high.alias("h")).collect()]
    assert got[0] == (None, None, None) and all(np.isnan(v) for v in got[1])
    assert got[2:] == [(0.0, 0.0, -1.0), (0.4, 0.4, 0.4), (1.0, 7.0, 1.0), (1.0, float("inf"), 1.0)]


def test_impact_of_an_unknown_severity_is_unknown(spark):
    cols = "avg_severity double, junction_fraction double, persistence_ratio double, violation_count long"
    df = spark.createDataFrame([(None, 0.5, 0.5, 10), (1.0, None, 0.5, 10), (float("nan"), 0.5, 0.5, 10)], cols)
    none, no_junction, nan = flow_impact(df).collect()
    for r in (none, no_junction):
        assert (r.capacity_loss_pct, r.shockwave_queue_km, r.effective_speed_kmh) == (None, None, None)
    assert np.isnan(nan.capacity_loss_pct) and np.isnan(nan.effective_speed_kmh)
    unknown = delay_cost(flow_impact(df), 10).first()
    assert unknown.daily_delay_cost_inr is None and unknown.annual_delay_cost_inr is None
