"""Record cleaning: null filter, tag parse, severity, relevance filter,
IST time parts, fills and the junction flag; then hexagonal binning.

One narrow projection/filter chain (no shuffle). Catalyst pushes the
``latitude/longitude/created_datetime IS NOT NULL`` filter into the scan.
Output columns follow the raw schema plus ``tags, severity, created_ist,
hour, weekday (0=Mon), date, at_junction``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbscope.functions.grid import hex_cell_id
from curbscope.functions.tags import parse_list, record_severity, strip_ws, with_tags
from curbscope.functions.timeparts import ist_timestamp
from curbscope.schema import DEFAULT_CENTER, NO_JUNCTION, UNKNOWN

CLEAN_EXTRA = ["tags", "severity", "created_ist", "hour", "weekday", "date", "at_junction"]


def clean_violations(raw: DataFrame, keep: list[str] = ()) -> DataFrame:
    """The clean records; ``keep`` columns of ``raw`` come first.

    Few, wide projections (each DataFrame step is analysed eagerly on the
    driver, so a long ``withColumn`` chain over large expressions costs
    planning time on every query)."""
    df = with_tags(raw, "violation_type", "tags",
                   extra={"created_ist": ist_timestamp(F.col("created_datetime"))})
    # Out of a generator of its own the severity is computed once a record;
    # as a plain column it would stand in the filter and in the projection.
    df = df.select("*", F.inline(F.array(F.struct(record_severity(F.col("tags")).alias("severity")))))
    junction = F.coalesce(F.col("junction_name"), F.lit(NO_JUNCTION))
    df = df.select(
        *keep, "id", "latitude", "longitude", "location",
        F.coalesce(F.col("vehicle_type"), F.lit(UNKNOWN)).alias("vehicle_type"),
        "violation_type", "offence_code", "created_datetime",
        F.coalesce(F.col("police_station"), F.lit(UNKNOWN)).alias("police_station"),
        junction.alias("junction_name"),
        "tags", "severity", "created_ist",
        F.hour("created_ist").alias("hour"), F.weekday("created_ist").alias("weekday"),
        F.to_date("created_ist").alias("date"),
        (F.lower(strip_ws(junction)) != F.lit("no junction")).alias("at_junction"),
    )
    return df.filter(
        F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
        & ~F.isnan("latitude") & ~F.isnan("longitude")      # CSV "NaN" is missing too
        & F.col("created_datetime").isNotNull()
        & (F.col("severity") > 0) & F.col("created_ist").isNotNull())


def quality_counts(raw: DataFrame) -> DataFrame:
    """One row: how many raw records there are, how many lack coordinates or
    a time, have a time that cannot be read, a tag text that is no list (it
    counts as one tag) or no parking tag, and how many cleaning keeps. A
    record can count under several reasons."""
    text = strip_ws(F.col("violation_type"))
    time, lat, lon = F.col("created_datetime"), F.col("latitude"), F.col("longitude")
    df = with_tags(raw, "violation_type", "tags", extra={
        "_ist": ist_timestamp(time), "_bare": (text != "") & parse_list(text).isNull()})
    no_place = lat.isNull() | lon.isNull() | F.isnan(lat) | F.isnan(lon)
    severity = record_severity(F.col("tags"))
    reasons = {
        "no_coordinates": no_place,
        "no_time": time.isNull(),
        "bad_time": time.isNotNull() & F.col("_ist").isNull(),
        "tag_fallbacks": F.coalesce(F.col("_bare"), F.lit(False)),
        "not_parking": severity <= 0,
        "kept": ~no_place & F.col("_ist").isNotNull() & (severity > 0),
    }
    return df.agg(F.count(F.lit(1)).alias("raw_rows"),
                  *[F.count_if(c).alias(name) for name, c in reasons.items()])


def add_hex_id(df: DataFrame, resolution: int = 9,
               origin: tuple[float, float] = DEFAULT_CENTER) -> DataFrame:
    return df.withColumn("hex_id", hex_cell_id(F.col("latitude"), F.col("longitude"),
                                               resolution, origin))
