"""The per-cell rollup: one pass over records, everything else reads it.

Each clean, binned record emits a few keyed rows (``explode`` of an array of
structs) and one hash aggregation with map-side combine collapses them:

======== ============================ ====================================
kind     key columns                  feeds
======== ============================ ====================================
day      hex_id, date                 counts, severity, junction, centroid,
                                      active days, weekly series, span
slot     hex_id, weekday, hour        busy hours, busy fraction, weekday x
                                      hour pivot, hourly density
station  hex_id, value                dominant station (mode)
vehicle  hex_id, value                dominant vehicle (mode)
tag      hex_id, value (one per tag)  tag breakdown, tag mix
======== ============================ ====================================

Measures per row: ``n`` (records), ``sev_sum``, ``jct_n`` and the centroid
accumulators ``lat_e7``/``lon_e7`` (coordinates as integer 1e-7 degree
units, about 1 cm, so cell centroids are exact sums, identical under any
partitioning or summation order).

Why: the rollup is bounded by cells x (days + 168 + stations + vehicles +
tags), not by record count, so a hot cell holding a third of all records
still becomes a few hundred rows after the map-side partial aggregate. The
records are scanned and parsed once; every downstream operator is a small
aggregation over this table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY_COLUMNS = ["hex_id", "kind", "date", "weekday", "hour", "value"]
MEASURES = ["n", "sev_sum", "jct_n", "lat_e7", "lon_e7"]
KEY_TYPE = "array<struct<kind:string,date:date,weekday:int,hour:int,value:string>>"


def _or_null(c: Column | None, type_name: str) -> Column:
    return F.lit(None).cast(type_name) if c is None else c


def _key(kind: str, date: Column | None = None, weekday: Column | None = None,
         hour: Column | None = None, value: Column | None = None) -> Column:
    return F.struct(F.lit(kind).alias("kind"), _or_null(date, "date").alias("date"),
                    _or_null(weekday, "int").alias("weekday"),
                    _or_null(hour, "int").alias("hour"),
                    _or_null(value, "string").alias("value"))


def e7(c: Column) -> Column:
    """Degrees -> integer 1e-7 degree units (round half up)."""
    return F.floor(c * F.lit(1e7) + F.lit(0.5))


def _tag_keys(tags: Column) -> Column:
    """One ``tag`` key per element, built with ``arrays_zip`` (no lambda, so
    the explode stays in whole-stage codegen)."""
    tags = F.coalesce(tags, F.array().cast("array<string>"))
    n = F.size(tags)
    return F.arrays_zip(
        F.array_repeat(F.lit("tag"), n), F.array_repeat(F.lit(None).cast("date"), n),
        F.array_repeat(F.lit(None).cast("int"), n), F.array_repeat(F.lit(None).cast("int"), n),
        tags,
    ).cast(KEY_TYPE)


KINDS = ("day", "slot", "station", "vehicle", "tag")


def cell_rollup(hexed: DataFrame, kinds: tuple[str, ...] = KINDS, more: list[str] = ()) -> DataFrame:
    """The rollup, of the given ``kinds`` only: a query that reads one kind
    makes one row per record of it instead of all. ``more`` columns of the
    records become keys too (partial rollups, which ``merged`` sums)."""
    own = {
        "day": lambda: _key("day", date=F.col("date")),
        "slot": lambda: _key("slot", weekday=F.col("weekday"), hour=F.col("hour")),
        "station": lambda: _key("station", value=F.col("police_station")),
        "vehicle": lambda: _key("vehicle", value=F.col("vehicle_type")),
    }
    fixed = [own[k]() for k in kinds if k in own]
    arrays = [F.array(*fixed).cast(KEY_TYPE)] if fixed else []
    arrays += [_tag_keys(F.col("tags"))] if "tag" in kinds else []
    keys = F.concat(*arrays)
    exploded = hexed.select(
        *more, "hex_id", F.explode(keys).alias("k"), "severity",
        F.col("at_junction").cast("long").alias("jct"),
        e7(F.col("latitude")).alias("lat7"), e7(F.col("longitude")).alias("lon7"),
    ).select(*more, "hex_id", "k.*", "severity", "jct", "lat7", "lon7")
    return exploded.groupBy(*more, *KEY_COLUMNS).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("severity").alias("sev_sum"),
        F.sum("jct").alias("jct_n"),
        F.sum("lat7").alias("lat_e7"),
        F.sum("lon7").alias("lon_e7"),
    )


def merged(parts: DataFrame) -> DataFrame:
    """One rollup from the rows of several."""
    return parts.groupBy(*KEY_COLUMNS).agg(*[F.sum(m).alias(m) for m in MEASURES])


def kind(rollup: DataFrame, name: str) -> DataFrame:
    return rollup.filter(F.col("kind") == name)


def from_e7(total: Column, n: Column) -> Column:
    """Mean coordinate from an e7 sum: two correctly rounded divisions."""
    return (total / n) / F.lit(1e7)
