"""Records in folders by date: what is read, and views of a part of the span."""

import datetime as dt

from pyspark.sql import functions as F

from curbscope.operators import periods as PD
from curbscope.plans import registry as R
from curbscope.sources.clean_table import read_clean, write_clean
from tests.conftest import SF001, rows
from tests.test_plans import plan_of


def made(spark, path):
    start = dt.date(2024, 3, 1)
    recs = [(f"h{i % 3}", start + dt.timedelta(days=i % 5), i % 24, float(i % 4), i % 2 == 0) for i in range(200)]
    recs += [("h9", start, 7, 1.0, False)] * 300
    df = spark.createDataFrame(recs, "hex_id string, date date, hour int, severity double, at_junction boolean")
    write_clean(df, path)
    return df


def test_a_range_of_dates_reads_its_folders_only(spark, tmp_path):
    df = made(spark, str(tmp_path / "t"))
    part = read_clean(spark, str(tmp_path / "t"), "2024-03-02", dt.date(2024, 3, 3))
    assert rows(part, *sorted(df.columns)) == rows(df.where("date between '2024-03-02' and '2024-03-03'"), *sorted(df.columns))
    plan = plan_of(part)
    filters = plan[plan.index("PartitionFilters"):][:200]
    assert "date" in filters and ">= 2024-03-02" in filters and "<= 2024-03-03" in filters
    scan = part._jdf.queryExecution().executedPlan().collectLeaves().head()
    part._jdf.queryExecution().toRdd().count()
    assert scan.metrics().apply("numPartitions").value() == 2
    assert read_clean(spark, str(tmp_path / "t")).count() == 500
    assert read_clean(spark, str(tmp_path / "t"), last="2024-02-01").count() == 0


def test_one_date_is_replaced(spark, tmp_path):
    df = made(spark, str(tmp_path / "t"))
    write_clean(df.where("date = '2024-03-04'").limit(3), str(tmp_path / "t"), mode="overwrite")
    assert read_clean(spark, str(tmp_path / "t"), "2024-03-04", "2024-03-04").count() == 3
    assert read_clean(spark, str(tmp_path / "t")).count() == 500 - 40 + 3


def test_a_date_of_many_records_is_several_files(spark, tmp_path):
    keys = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16k"}
    prev = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        df = spark.range(60_000).select(F.md5(F.col("id").cast("string").cast("binary")).alias("id"), F.when(F.col("id") % 20 == 0, F.to_date(
            F.lit("2024-01-02"))).otherwise(F.to_date(F.lit("2024-01-01"))).alias("date")).repartition(6)
        write_clean(df, str(tmp_path / "t"))
    finally:
        for k, v in prev.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    files = {d.name: len(list(d.glob("part-*"))) for d in (tmp_path / "t").glob("date=*")}
    assert files["date=2024-01-01"] >= 4 and files["date=2024-01-02"] <= 3


def test_peak_days_prune_at_run_time(spark, tmp_path):
    made(spark, str(tmp_path / "t"))
    table = read_clean(spark, str(tmp_path / "t"))
    assert [tuple(r) for r in PD.peak_days(table, 2).collect()] == [(dt.date(2024, 3, 1), 340), (dt.date(2024, 3, 2), 40)]
    slots = PD.peak_day_slots(table, 1)
    assert "dynamicpruningexpression(date" in plan_of(slots)
    got = {(r.date, r.hour): (r.n, r.share) for r in slots.collect()}
    assert got[(dt.date(2024, 3, 1), 7)][0] >= 300 and sum(n for n, _ in got.values()) == 340
    assert abs(sum(s for _, s in got.values()) - 1) < 1e-9


def test_period_views(spark, tmp_path):
    made(spark, str(tmp_path / "t"))
    table = read_clean(spark, str(tmp_path / "t"))
    cells = {r.hex_id: r for r in PD.period_cells(read_clean(spark, str(tmp_path / "t"), "2024-03-01", "2024-03-01")).collect()}
    assert cells["h9"].violation_count == 300 and cells["h9"].junction_fraction == 0 and cells["h9"].active_days == 1
    change = {r.hex_id: (r.before, r.after, r.change) for r in
              PD.period_change(table, ("2024-03-01", "2024-03-01"), ("2024-03-04", "2024-03-05")).collect()}
    assert change["h9"] == (300, 0, -300) and sum(c[1] for c in change.values()) == 80
    assert "2024-03-04" in plan_of(PD.period_change(table, ("2024-03-01",) * 2, ("2024-03-04",) * 2)).split("PartitionFilters")[1][:300]
    assert PD.period_hours(table.limit(0)).count() == 0


def test_registered_views_prune(spark):
    assert ">= 2024-01-08" in plan_of(R.QUERIES["period_cells"](spark, SF001)).split("PartitionFilters")[1][:200]
