"""Per-cell feature table from the rollup (one aggregation, no joins but a
broadcast of the <=24-row busy-hour set).

Columns: hex_id, violation_count, severity_weighted_count, avg_severity,
junction_fraction, busy_hour_fraction, active_days, latitude, longitude,
dominant_station, dominant_vehicle, persistence_ratio.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbscope.operators.busy import busy_hours, n_days_scalar
from curbscope.operators.rollup import from_e7, kind
from curbscope.schema import UNKNOWN


def _when_kind(name: str, c: Column) -> Column:
    return F.when(F.col("kind") == name, c)


def _mode(name: str) -> Column:
    """Most frequent non-NULL value of one kind; ties -> smallest value;
    no value -> "Unknown".

    ``min(struct(-n, value))`` is an ordinary partial-aggregable aggregate
    over the (hex, value) counts already in the rollup.
    """
    cand = F.when((F.col("kind") == name) & F.col("value").isNotNull(),
                  F.struct((-F.col("n")).alias("neg_n"), F.col("value").alias("v")))
    best = F.min(cand)
    return F.coalesce(best.getField("v"), F.lit(UNKNOWN))


def flag_busy(rollup: DataFrame, busy: DataFrame) -> DataFrame:
    """Add ``is_busy`` to rollup rows (broadcast join on hour; busy <= 24 rows)."""
    flags = F.broadcast(busy.select("hour", F.lit(True).alias("is_busy")))
    return rollup.join(flags, "hour", "left").withColumn(
        "is_busy", F.coalesce(F.col("is_busy"), F.lit(False)))


def hotspot_features(rollup: DataFrame, busy: DataFrame | None = None,
                     coverage: float = 0.5) -> DataFrame:
    if busy is None:
        busy = busy_hours(rollup, coverage)
    flagged = flag_busy(rollup, busy)
    day_n = _when_kind("day", F.col("n"))
    agg = flagged.groupBy("hex_id").agg(
        F.sum(day_n).alias("violation_count"),
        F.sum(_when_kind("day", F.col("sev_sum"))).alias("severity_weighted_count"),
        F.sum(_when_kind("day", F.col("jct_n"))).alias("_jct"),
        F.sum(F.when((F.col("kind") == "slot") & F.col("is_busy"), F.col("n"))).alias("_busy"),
        F.count(_when_kind("day", F.lit(1))).alias("active_days"),
        F.sum(_when_kind("day", F.col("lat_e7"))).alias("_lat"),
        F.sum(_when_kind("day", F.col("lon_e7"))).alias("_lon"),
        _mode("station").alias("dominant_station"),
        _mode("vehicle").alias("dominant_vehicle"),
    )
    n = F.col("violation_count")
    n_days = n_days_scalar(rollup)
    return agg.select(
        "hex_id", "violation_count", "severity_weighted_count",
        (F.col("severity_weighted_count") / n).alias("avg_severity"),
        (F.col("_jct") / n).alias("junction_fraction"),
        (F.coalesce(F.col("_busy"), F.lit(0)) / n).alias("busy_hour_fraction"),
        "active_days",
        from_e7(F.col("_lat"), n).alias("latitude"),
        from_e7(F.col("_lon"), n).alias("longitude"),
        "dominant_station", "dominant_vehicle",
        F.least(F.col("active_days") / n_days, F.lit(1.0)).alias("persistence_ratio"),
    )


def tag_breakdown_long(rollup: DataFrame) -> DataFrame:
    """(hex_id, tag, count) over all tags, repeated tags counted each time."""
    return (kind(rollup, "tag")
            .select("hex_id", F.col("value").alias("tag"), F.col("n").alias("count")))


def tag_breakdown_map(rollup: DataFrame) -> DataFrame:
    """(hex_id, tag_breakdown map<string,bigint>); zero counts never appear.
    The per-cell list is bounded by the tag vocabulary."""
    return (kind(rollup, "tag").groupBy("hex_id")
            .agg(F.map_from_entries(F.array_sort(F.collect_list(
                F.struct(F.col("value"), F.col("n"))))).alias("tag_breakdown")))


def dominant_values(rollup: DataFrame) -> DataFrame:
    """(hex_id, dominant_station, dominant_vehicle)."""
    return rollup.groupBy("hex_id").agg(
        _mode("station").alias("dominant_station"),
        _mode("vehicle").alias("dominant_vehicle"))
