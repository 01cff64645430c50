"""Busy hours, observation span and weekly counts from the cell rollup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curbscope.operators.rollup import kind


def hour_counts(rollup: DataFrame) -> DataFrame:
    """City-wide records per hour of day (at most 24 rows)."""
    return (kind(rollup, "slot").groupBy("hour")
            .agg(F.sum("n").alias("n")))


def busy_hours(rollup: DataFrame, coverage: float = 0.5) -> DataFrame:
    """Smallest set of hours, taken by count desc (ties: earlier hour
    first), whose cumulative share reaches ``coverage``.

    An hour is kept when the cumulative share *before* it is still below
    ``coverage`` (so the first hour is always kept). The input is at most 24
    rows, so a global running-sum window over it is free.
    Output: ``hour int, n bigint, cum_share double``.
    """
    return busy_hours_from_counts(hour_counts(rollup), coverage)


def busy_hours_from_counts(counts: DataFrame, coverage: float = 0.5) -> DataFrame:
    w = Window.orderBy(F.col("n").desc(), F.col("hour").asc())
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    df = counts.withColumns({
        "_cum": F.sum("n").over(running),
        "_total": total,
    }).withColumn("cum_share", F.col("_cum") / F.col("_total"))
    prev_share = (F.col("_cum") - F.col("n")) / F.col("_total")
    first = F.col("_cum") == F.col("n")   # kept at any coverage, 0 included
    return (df.filter(first | (prev_share < F.lit(float(coverage))))
            .select("hour", "n", "cum_share"))


def observation_days(rollup: DataFrame) -> DataFrame:
    """One row: ``n_days = max(datediff(max(date), min(date)), 1)``."""
    day = kind(rollup, "day")
    return day.agg(
        F.greatest(F.datediff(F.max("date"), F.min("date")), F.lit(1)).alias("n_days"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def n_days_scalar(rollup: DataFrame) -> Column:
    """``n_days`` as a scalar subquery (no cross join; NULL on empty input)."""
    return observation_days(rollup).select("n_days").scalar()


def week_start(date: Column) -> Column:
    """Monday of the week containing ``date``."""
    return F.to_date(F.date_trunc("week", date))


def weekly_counts(rollup: DataFrame) -> DataFrame:
    """Records per (hex_id, Monday week); only non-empty weeks."""
    return (kind(rollup, "day")
            .groupBy("hex_id", week_start(F.col("date")).alias("week"))
            .agg(F.sum("n").alias("count")))
