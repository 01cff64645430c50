"""Busy hours, mode, rollup invariants, weekly trend and forecast."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from curbscope.operators import busy as B
from curbscope.operators import features as FT
from curbscope.operators import trend as TR
from curbscope.operators.rollup import cell_rollup
from curbscope.plans import registry as R
from tests.conftest import SF01


def busy_of(spark, counts, coverage=0.5):
    df = spark.createDataFrame(list(counts.items()) or [], "hour int, n long")
    return sorted(r.hour for r in B.busy_hours_from_counts(df, coverage).collect())


def test_busy_hours_cases(spark):
    assert busy_of(spark, {5: 10}) == [5]
    assert busy_of(spark, {1: 5, 2: 5}) == [1]               # exact 50 % hit
    assert busy_of(spark, {3: 4, 1: 4, 2: 2}) == [1, 3]      # tie at the cut
    assert busy_of(spark, {1: 6, 2: 3, 3: 1}) == [1]
    assert busy_of(spark, {1: 4, 2: 3, 3: 3}) == [1, 2]
    assert busy_of(spark, {1: 4, 2: 3, 3: 3}, coverage=1.0) == [1, 2, 3]
    assert busy_of(spark, {}) == []


def test_busy_set_is_minimal(spark):
    roll = R.rollup(spark, SF01)
    counts = {r.hour: r.n for r in B.hour_counts(roll).collect()}
    busy = busy_of(spark, counts)
    total = sum(counts.values())
    share = sum(counts[h] for h in busy) / total
    assert share >= 0.5
    smallest = min(counts[h] for h in busy)
    assert (share - smallest / total) < 0.5


def _rollup_of(spark, rows):
    """rows: (hex_id, date, hour, station, vehicle, tags, severity)."""
    df = spark.createDataFrame(
        [(h, d, hr, d.weekday(), st, ve, tags, sev, False, 12.9, 77.5)
         for h, d, hr, st, ve, tags, sev in rows],
        "hex_id string, date date, hour int, weekday int, police_station string, "
        "vehicle_type string, tags array<string>, severity double, at_junction boolean, "
        "latitude double, longitude double")
    return cell_rollup(df)


def test_mode_cases(spark):
    d = dt.date(2024, 1, 1)
    rows = [("a", d, 1, "PS-2", "CAR", ["NO PARKING"], 1.5),
            ("a", d, 1, "PS-2", "BUS", ["NO PARKING"], 1.5),
            ("a", d, 1, "PS-1", "BUS", ["NO PARKING"], 1.5),   # clear winner PS-2
            ("b", d, 1, "PS-9", "CAR", ["NO PARKING"], 1.5),
            ("b", d, 1, "PS-3", "AUTO", ["NO PARKING"], 1.5),  # tie -> smallest
            ("c", d, 1, None, None, ["NO PARKING"], 1.5)]      # all NULL -> Unknown
    got = {r.hex_id: (r.dominant_station, r.dominant_vehicle)
           for r in FT.dominant_values(_rollup_of(spark, rows)).collect()}
    assert got == {"a": ("PS-2", "BUS"), "b": ("PS-3", "AUTO"), "c": ("Unknown", "Unknown")}


def test_rollup_invariants(spark):
    recs = R.records(spark, SF01)
    roll = cell_rollup(recs)
    feats = FT.hotspot_features(roll)
    n = recs.count()
    assert feats.agg(F.sum("violation_count")).first()[0] == n
    n_tags = recs.agg(F.sum(F.size("tags"))).first()[0]
    assert FT.tag_breakdown_long(roll).agg(F.sum("count")).first()[0] == n_tags
    bad = feats.filter((F.col("persistence_ratio") > 1) | (F.col("persistence_ratio") <= 0)
                       | (F.col("busy_hour_fraction") > 1) | (F.col("junction_fraction") > 1))
    assert bad.count() == 0


def _weekly(spark, series):
    return spark.createDataFrame(
        [(h, dt.date(2024, 1, 1) + dt.timedelta(weeks=w), c) for h, pts in series.items()
         for w, c in pts], "hex_id string, week date, count long")


def test_growth_and_forecast(spark):
    series = {
        "one": [(0, 7)],
        "two": [(0, 10), (1, 20)],
        "three": [(0, 10), (1, 20), (2, 30)],
        "gap": [(0, 10), (2, 20), (4, 30)],          # ordinal index collapses the gaps
        "fall": [(0, 30), (1, 20), (2, 10)],
        "flat": [(0, 5), (1, 5), (2, 5), (3, 5)],
    }
    weekly = _weekly(spark, series)
    g = {r.hex_id: r.growth_rate for r in TR.growth_trend(weekly).collect()}
    assert g == {"one": 0.0, "two": 0.0, "three": 0.5, "gap": 0.5, "fall": -0.5, "flat": 0.0}
    f = {(r.hex_id, r.step): (r.week, r.forecast_count) for r in TR.forecast_all(weekly).collect()}
    assert f[("one", 1)][1] == 7.0 and f[("two", 2)][1] == 15.0
    assert f[("three", 1)][1] == pytest.approx(40.0) and f[("three", 2)][1] == pytest.approx(50.0)
    assert f[("fall", 1)][1] == 0.0 and f[("fall", 2)][1] == 0.0      # clipped at 0
    last = dt.date(2024, 1, 15)
    assert f[("three", 1)][0] == last + dt.timedelta(days=7)
    ref = {(r.hex_id, r.step): r.week for r in TR.forecast_all(weekly, label="reference").collect()}
    assert ref[("three", 1)] == last + dt.timedelta(days=13)
    assert ref[("three", 2)] == last + dt.timedelta(days=20)
    hf = TR.history_forecast(weekly).filter(F.col("hex_id") == "three").orderBy("week").collect()
    assert [(r.history, r.forecast) for r in hf] == [(10.0, None), (20.0, None), (30.0, None),
                                                      (None, pytest.approx(40.0)),
                                                      (None, pytest.approx(50.0))]


def test_week_start_is_monday(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 7),), (dt.date(2024, 1, 8),)], "d date")
    got = [r.w for r in df.select(B.week_start(F.col("d")).alias("w")).orderBy("d").collect()]
    assert got == [dt.date(2024, 1, 1), dt.date(2024, 1, 8)]


def test_first_busy_hour_is_kept_at_any_coverage(spark):
    counts = spark.createDataFrame([(8, 10), (9, 30), (10, 20)], "hour int, n long")
    assert [r.hour for r in B.busy_hours_from_counts(counts, 0.0).collect()] == [9]
    assert [r.hour for r in B.busy_hours_from_counts(counts, 0.5).collect()] == [9]
    assert B.busy_hours_from_counts(counts.limit(0), 0.0).count() == 0


def test_rollup_of_one_kind(spark):
    from curbscope.operators.rollup import cell_rollup, kind
    from curbscope.plans import registry as R
    from tests.conftest import SF001

    recs = R.records(spark, SF001)
    whole = cell_rollup(recs)
    for name in ("day", "slot", "tag"):
        own = cell_rollup(recs, (name,))
        assert sorted(map(str, own.collect())) == sorted(map(str, kind(whole, name).collect()))
