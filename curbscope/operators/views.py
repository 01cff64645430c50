"""Table results behind the dashboard: filtered views, map layers, KPIs,
temporal pivots, tag mix, hourly density, drill-down, options, profile.

All are small aggregations over the cell table or the cell rollup; none
touches records again except ``profile_clean``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curbscope import schema as S
from curbscope.functions.numeric import clip, rint_round
from curbscope.functions.text import recommended_action
from curbscope.operators.ranks import ordinal_rank
from curbscope.operators.rollup import from_e7, kind
from curbscope.operators.score import cis_order


# ---------------------------------------------------------------------------
# filtered views, top-N, drill-down
# ---------------------------------------------------------------------------
def hotspot_view(hotspots: DataFrame, tiers: list[str] | None = None,
                 stations: list[str] | None = None) -> DataFrame:
    """Tier filter (``None`` = all tiers, ``[]`` = no rows) and station
    filter (``None``/``[]`` = no filter), sorted by CIS desc."""
    view = hotspots
    if tiers is not None:
        view = view.filter(F.col("tier").isin(list(tiers))) if tiers else view.limit(0)
    if stations:
        view = view.filter(F.col("dominant_station").isin(list(stations)))
    return view.orderBy(*cis_order())


def with_action(df: DataFrame) -> DataFrame:
    return df.withColumn("recommended_action", recommended_action(
        F.col("junction_fraction"), F.col("busy_hour_fraction"),
        F.col("persistence_ratio"), F.col("growth_rate")))


def priority_list(view: DataFrame, top_n: int = 25) -> DataFrame:
    """Top-N cells by CIS with their recommended action."""
    return with_action(view.orderBy(*cis_order()).limit(int(top_n)))


# fixed values: the report's column names (output contract)
REPORT_COLUMNS = [
    ("hex_id", "hex_id"), ("dominant_station", "station"),
    ("violation_count", "violations"), ("congestion_impact_score", "cis"),
    ("tier", "tier"), ("capacity_loss_pct", "lane_loss_pct"),
    ("shockwave_queue_km", "queue_km"), ("daily_delay_cost_inr", "daily_cost_inr"),
    ("annual_delay_cost_inr", "annual_cost_inr"), ("junction_fraction", "pct_at_junction"),
    ("busy_hour_fraction", "pct_busy_hours"), ("persistence_ratio", "persistence"),
    ("growth_rate", "weekly_growth"), ("recommended_action", "recommended_action"),
]


def priority_report(view: DataFrame, top_n: int = 25) -> DataFrame:
    """The 14-column priority table (numeric values, report names)."""
    top = priority_list(view, top_n)
    return top.select(*[F.col(src).alias(dst) for src, dst in REPORT_COLUMNS])


def priority_report_display(report: DataFrame) -> DataFrame:
    """Display strings: .1f, .2f, thousands separators, percentages.

    Each value is first rounded half-even to the printed precision
    (``rint_round``), so the text does not depend on the formatter's own
    tie rule (Java rounds half-up on the decimal text)."""
    def fixed(c: str, digits: int, scale: float = 1.0, fmt: str | None = None) -> Column:
        v = rint_round(F.col(c) * F.lit(scale), digits) if scale != 1.0 else rint_round(F.col(c), digits)
        return F.format_string(fmt or f"%.{digits}f", v)

    def pct(c: str, signed: bool = False) -> Column:
        return fixed(c, 1, 100.0, "%+.1f%%" if signed else "%.1f%%")

    return report.select(
        "hex_id", "station", "violations",
        fixed("cis", 1).alias("cis"), "tier",
        fixed("lane_loss_pct", 1).alias("lane_loss_pct"),
        fixed("queue_km", 2).alias("queue_km"),
        F.format_number("daily_cost_inr", 0).alias("daily_cost_inr"),
        F.format_number("annual_cost_inr", 0).alias("annual_cost_inr"),
        pct("pct_at_junction").alias("pct_at_junction"),
        pct("pct_busy_hours").alias("pct_busy_hours"),
        pct("persistence").alias("persistence"),
        pct("weekly_growth", signed=True).alias("weekly_growth"),
        "recommended_action")


def hotspot_options(view: DataFrame, limit: int = 100) -> DataFrame:
    """Drill-down choices: ``"hex — station"`` for the first ``limit`` cells."""
    top = view.orderBy(*cis_order()).limit(int(limit))
    return top.select("hex_id", F.concat_ws(" — ", "hex_id", "dominant_station").alias("label"))


def hotspot_lookup(hotspots: DataFrame, keys: DataFrame | str) -> DataFrame:
    """Rows of the given cell id(s); ``keys`` is an id or a (hex_id) frame."""
    if isinstance(keys, str):
        return hotspots.filter(F.col("hex_id") == keys)
    return hotspots.join(keys.select("hex_id").distinct(), "hex_id", "left_semi")


def hex_of_label(label: Column) -> Column:
    return F.split(label, " — ").getItem(0)


# ---------------------------------------------------------------------------
# map layers
# ---------------------------------------------------------------------------
def _tier_color(i: int) -> Column:
    kv = []
    for tier, rgba in S.TIER_COLORS.items():
        kv += [F.lit(tier), F.lit(rgba[i])]
    return F.try_element_at(F.create_map(*kv), F.col("tier"))


def map_layer(view: DataFrame) -> DataFrame:
    """Per cell: RGBA fill by tier, extrusion = CIS * 30, tooltip fields."""
    return view.select(
        "hex_id", "latitude", "longitude", "dominant_station", "violation_count",
        "congestion_impact_score", "tier", "capacity_loss_pct", "shockwave_queue_km",
        "daily_delay_cost_inr",
        _tier_color(0).alias("color_r"), _tier_color(1).alias("color_g"),
        _tier_color(2).alias("color_b"), _tier_color(3).alias("color_a"),
        (F.col("congestion_impact_score") * F.lit(float(S.MAP_ELEVATION_SCALE))).alias("elevation"))


def map_center(view: DataFrame) -> DataFrame:
    """Mean latitude/longitude of the view, default centre when empty."""
    return view.agg(
        F.coalesce(F.avg("latitude"), F.lit(S.DEFAULT_CENTER[0])).alias("center_lat"),
        F.coalesce(F.avg("longitude"), F.lit(S.DEFAULT_CENTER[1])).alias("center_lon"))


# ---------------------------------------------------------------------------
# KPIs
# ---------------------------------------------------------------------------
def busy_hours_label(busy: DataFrame) -> DataFrame:
    """One row: ``"08h, 09h"`` (sorted)."""
    return busy.agg(F.array_join(F.array_sort(F.collect_list(
        F.format_string("%02dh", F.col("hour")))), ", ").alias("busy_hours"))


def kpis(hotspots: DataFrame, rollup: DataFrame, busy: DataFrame) -> DataFrame:
    """One row of headline numbers (busy set and record count are scalar
    subqueries over <=24-row and rollup aggregates)."""
    records = kind(rollup, "day").agg(F.sum("n")).scalar()
    label = busy_hours_label(busy).scalar()
    k = hotspots.agg(
        F.count(F.lit(1)).alias("hotspots"),
        F.count_if(F.col("tier").isin("Critical", "High")).alias("critical_high"),
        F.avg("congestion_impact_score").alias("avg_cis"),
        F.coalesce(F.sum("daily_delay_cost_inr"), F.lit(0)).cast("long").alias("daily_cost_total"),
        F.coalesce(F.sum("annual_delay_cost_inr"), F.lit(0)).cast("long").alias("annual_cost_total"),
    )
    return k.select(
        F.coalesce(records, F.lit(0)).cast("long").alias("violations"), "hotspots",
        "critical_high", "avg_cis", "daily_cost_total", "annual_cost_total",
        rint_round(F.col("annual_cost_total") / F.lit(1e7), 1).alias("annual_cost_crore"),
        F.coalesce(label, F.lit("")).alias("busy_hours"))


# ---------------------------------------------------------------------------
# temporal views
# ---------------------------------------------------------------------------
def weekday_hour_pivot(rollup: DataFrame) -> DataFrame:
    """Records per weekday (0=Mon) x hour, all 24 hour columns, 0 if empty.
    Labelled by weekday number, so a missing weekday never shifts labels."""
    slot = kind(rollup, "slot")
    wide = (slot.groupBy("weekday").pivot("hour", list(range(24))).agg(F.sum("n")))
    return wide.select("weekday", *[F.coalesce(F.col(str(h)), F.lit(0)).cast("long")
                                    .alias(f"h{h:02d}") for h in range(24)])


def weekday_hour_counts(rollup: DataFrame) -> DataFrame:
    """Long form of the pivot: (weekday, hour, count)."""
    return (kind(rollup, "slot").groupBy("weekday", "hour")
            .agg(F.sum("n").alias("count")))


def tag_mix(rollup: DataFrame) -> DataFrame:
    """Parking-tag counts over all records, count desc (ties by tag)."""
    parking = F.array(*[F.lit(t) for t in S.PARKING_SEVERITY_WEIGHTS])
    return (kind(rollup, "tag").filter(F.array_contains(parking, F.col("value")))
            .groupBy(F.col("value").alias("tag")).agg(F.sum("n").alias("count"))
            .orderBy(F.col("count").desc(), F.col("tag")))


def hourly_density(rollup: DataFrame, hour: int | None = None) -> DataFrame:
    """Per (hour, cell): count, mean position, ``norm = count / max count of
    that hour``, colour ``[255, int(255 * (1 - 0.8 norm)), 0, 180]`` and
    radius ``int(250 norm + 40)``, for all 24 hours at once (or one
    ``hour``). The per-hour maximum is a <=24-row aggregate joined back by
    broadcast."""
    slots = kind(rollup, "slot")
    if hour is not None:
        slots = slots.filter(F.col("hour") == int(hour))
    per = (slots.groupBy("hour", "hex_id")
           .agg(F.sum("n").alias("count"), F.sum("lat_e7").alias("_lat"),
                F.sum("lon_e7").alias("_lon")))
    peak = per.groupBy("hour").agg(F.max("count").alias("_max"))
    per = per.join(F.broadcast(peak), "hour")
    norm = clip(F.col("count") / F.col("_max"), 0.0, 1.0)
    green = F.floor(F.lit(float(S.DENSITY_RED)) * (F.lit(1.0) - F.col("norm")
                                                   * F.lit(S.DENSITY_GREEN_DROP)))
    radius = F.floor(F.col("norm") * F.lit(float(S.DENSITY_RADIUS_SCALE))
                     + F.lit(float(S.DENSITY_RADIUS_MIN)))
    return (per.withColumn("norm", norm)
            .select("hour", "hex_id", "count",
                    from_e7(F.col("_lat"), F.col("count")).alias("lat"),
                    from_e7(F.col("_lon"), F.col("count")).alias("lon"),
                    "norm",
                    F.lit(S.DENSITY_RED).alias("color_r"), green.cast("int").alias("color_g"),
                    F.lit(S.DENSITY_BLUE).alias("color_b"), F.lit(S.DENSITY_ALPHA).alias("color_a"),
                    radius.cast("int").alias("radius")))


def hourly_totals(rollup: DataFrame, busy: DataFrame) -> DataFrame:
    """Per hour: records, distinct cells, and whether it is a busy hour."""
    per = (kind(rollup, "slot").groupBy("hour")
           .agg(F.sum("n").alias("violations"), F.countDistinct("hex_id").alias("locations")))
    flags = F.broadcast(busy.select("hour", F.lit(True).alias("is_busy")))
    return per.join(flags, "hour", "left").select(
        "hour", "violations", "locations", F.coalesce(F.col("is_busy"), F.lit(False)).alias("is_busy"))


def tag_breakdown_sorted(rollup: DataFrame) -> DataFrame:
    """Each cell's tag counts in display order (count desc, tag asc)."""
    tags = kind(rollup, "tag").select("hex_id", F.col("value").alias("tag"), F.col("n").alias("count"))
    w = Window.partitionBy("hex_id").orderBy(F.col("count").desc(), F.col("tag"))
    return tags.withColumn("position", F.row_number().over(w))


# ---------------------------------------------------------------------------
# options and profile
# ---------------------------------------------------------------------------
def filter_options(hotspots: DataFrame) -> DataFrame:
    """(option, value, position): distinct tiers (CIS order of first
    appearance; at most four rows), sorted distinct stations (distributed
    rank), tag weights by weight desc."""
    first = hotspots.groupBy("tier").agg(F.max("congestion_impact_score").alias("_top"))
    tiers = first.select(F.lit("tier").alias("option"), F.col("tier").alias("value"),
                         F.row_number().over(Window.orderBy(F.col("_top").desc(), "tier"))
                         .alias("position"))
    stations = ordinal_rank(hotspots.select("dominant_station").distinct(),
                            [F.col("dominant_station")], "position").select(
        F.lit("station").alias("option"), F.col("dominant_station").alias("value"),
        F.col("position").cast("int").alias("position"))
    ranked = sorted(S.PARKING_SEVERITY_WEIGHTS.items(), key=lambda kv: -kv[1])
    spark = hotspots.sparkSession
    weights = spark.createDataFrame(
        [("weight", f"{t}: {w}", i + 1) for i, (t, w) in enumerate(ranked)],
        "option string, value string, position int")
    return tiers.unionByName(stations).unionByName(weights)


PROFILE_COLUMNS = ("severity", "hour", "weekday", "at_junction")


def value_histogram(records: DataFrame) -> DataFrame:
    """(column, x, n): how often each value of the profile's columns occurs.

    Records are counted once by all four together, a table bounded by the
    product of their few values; each column's histogram is summed over it."""
    joint = records.groupBy(
        F.col("severity").cast("double").alias("severity"), F.col("hour").cast("double").alias("hour"),
        F.col("weekday").cast("double").alias("weekday"),
        F.col("at_junction").cast("int").cast("double").alias("at_junction")).agg(F.count(F.lit(1)).alias("n"))
    kv = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("x")) for c in PROFILE_COLUMNS]))
    return joint.select(kv.alias("kv"), "n").groupBy("kv.column", "kv.x").agg(F.sum("n").alias("n"))


def profile_clean(records: DataFrame) -> DataFrame:
    """count, mean, std (sample), min, quartiles (linear), max of severity,
    hour, weekday and at_junction (as 0/1), from their value histograms: sums
    weighted by count, and quartiles by running counts over the sorted
    values (at most 24 a column)."""
    own = Window.partitionBy("column")
    upto = own.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    hist = value_histogram(records).where(F.col("x").isNotNull()).select(
        "column", "x", "n", F.sum("n").over(upto).alias("upto"), F.sum("n").over(own).alias("total"),
        (F.sum(F.col("x") * F.col("n")).over(own) / F.sum("n").over(own)).alias("mean"))

    def at(place: Column) -> Column:   # value at a 0-based place among the sorted records
        return F.min(F.when(F.col("upto") > place, F.col("x")))

    def quantile(p: float) -> Column:
        place = (F.col("total") - 1) * F.lit(p)
        low, high = at(F.floor(place)), at(F.ceil(place))
        part = F.max(place - F.floor(place))
        return F.when(part == 0, low).otherwise((F.lit(1.0) - part) * low + part * high)

    gap = F.col("x") - F.col("mean")
    n = F.sum("n")
    return hist.groupBy("column").agg(
        n.alias("count"), F.max("mean").alias("mean"),
        F.when(n > 1, F.sqrt(F.sum(gap * gap * F.col("n")) / (n - 1))).alias("std"),
        F.min("x").alias("min"), quantile(0.25).alias("p25"), quantile(0.5).alias("p50"),
        quantile(0.75).alias("p75"), F.max("x").alias("max"))
