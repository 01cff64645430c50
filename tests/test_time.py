"""UTC text -> IST parts, independent of the session time zone."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from curbscope.functions.timeparts import ist_timestamp

TIME_CASES = [
    ("2024-01-01 18:29:59+00", dt.datetime(2024, 1, 1, 23, 59, 59), 23, 0),
    ("2024-01-01 18:30:00+00", dt.datetime(2024, 1, 2, 0, 0, 0), 0, 1),
    ("2024-01-01 10:00:00.5+00", dt.datetime(2024, 1, 1, 15, 30, 0, 500000), 15, 0),
    ("2024-01-01 10:00:00Z", dt.datetime(2024, 1, 1, 15, 30), 15, 0),
    ("2024-01-01T10:00:00+05:30", dt.datetime(2024, 1, 1, 10, 0), 10, 0),
    ("2024-01-01 10:00:00", dt.datetime(2024, 1, 1, 15, 30), 15, 0),
    (" 2024-01-01 10:00:00+00 ", dt.datetime(2024, 1, 1, 15, 30), 15, 0),
    ("2024-01-07 18:29:59+00", dt.datetime(2024, 1, 7, 23, 59, 59), 23, 6),
    ("2024-01-07 18:30:00+00", dt.datetime(2024, 1, 8, 0, 0), 0, 0),
    ("2024-03-10 07:15:00+00", dt.datetime(2024, 3, 10, 12, 45), 12, 6),
    ("2024-01-01 10:00:00z", dt.datetime(2024, 1, 1, 15, 30), 15, 0),
    ("2024-01-01 10:00:00+0530", dt.datetime(2024, 1, 1, 10, 0), 10, 0),
    ("2024-01-01 10:00:00 UTC", dt.datetime(2024, 1, 1, 15, 30), 15, 0),
    ("not-a-date", None, None, None),
    (None, None, None, None),
]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_ist_parts(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(TIME_CASES)], "i int, s string")
        ist = ist_timestamp(F.col("s"))
        out = {r.i: r for r in df.select("i", ist.alias("ts"), F.hour(ist).alias("h"),
                                         F.weekday(ist).alias("wd"),
                                         F.to_date(ist).alias("d")).collect()}
        for i, (_, ts, h, wd) in enumerate(TIME_CASES):
            r = out[i]
            assert r.ts == ts, (TIME_CASES[i], r.ts)
            assert r.h == h and r.wd == wd
            assert r.d == (ts.date() if ts else None)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
