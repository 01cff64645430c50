"""Views of a part of the observation span, on records in folders by date
(``sources.clean_table``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curbscope.operators.busy import busy_hours_from_counts


def period_hours(records: DataFrame, coverage: float = 0.5) -> DataFrame:
    """Busy hours of the records' own period."""
    return busy_hours_from_counts(records.groupBy("hour").agg(F.count(F.lit(1)).alias("n")), coverage)


def period_cells(records: DataFrame) -> DataFrame:
    """Per cell of the period: records, severity total, active days and the
    share at junctions."""
    return records.groupBy("hex_id").agg(
        F.count(F.lit(1)).alias("violation_count"), F.sum("severity").alias("severity_weighted_count"),
        F.countDistinct("date").alias("active_days"),
        (F.sum(F.col("at_junction").cast("long")) / F.count(F.lit(1))).alias("junction_fraction"))


def peak_days(records: DataFrame, days: int) -> DataFrame:
    """(date, n): the ``days`` dates with most records, earlier ones first
    among equals. Counted per date before the shuffle; the ranking sees one
    row a date. (A filter on the rank, unlike a limit, lets Spark prune the
    folders of what is joined with it.)"""
    counts = records.groupBy("date").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.orderBy(F.desc("n"), "date"))
    return counts.withColumn("place", place).where(F.col("place") <= days).select("date", "n")


def peak_day_slots(records: DataFrame, days: int) -> DataFrame:
    """(date, hour, n, share): the hourly course of the busiest days. The
    days are ``days`` rows, so their join prunes the folders that are read."""
    top = peak_days(records, days).withColumnRenamed("n", "day_total")
    slots = records.join(F.broadcast(top), "date").groupBy("date", "hour", "day_total").agg(F.count(F.lit(1)).alias("n"))
    return slots.select("date", "hour", "n", (F.col("n") / F.col("day_total")).alias("share"))


def period_change(records: DataFrame, before: tuple[str, str], after: tuple[str, str]) -> DataFrame:
    """(hex_id, before, after, change): records per cell in two periods (the
    dates between them are not read); cells of either."""
    day = F.col("date")
    inside = lambda p: day.between(F.lit(p[0]).cast("date"), F.lit(p[1]).cast("date"))
    both = records.where(inside(before) | inside(after))
    return both.groupBy("hex_id").agg(
        F.count_if(inside(before)).alias("before"), F.count_if(inside(after)).alias("after")).withColumn(
        "change", F.col("after") - F.col("before"))
