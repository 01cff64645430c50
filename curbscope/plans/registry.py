"""Registered queries: ``name -> f(spark, sf_dir) -> DataFrame``.

Every query reads the driver tables of ``sf_dir`` (violations are derived
from ``events``, see ``sources.events``) and runs over the whole table.
The matching DuckDB SQL lives in ``plans.oracle_queries``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbscope.functions.grid import City, add_city_cells
from curbscope.functions.numeric import rint_round
from curbscope.functions.tags import parse_tags, record_severity
from curbscope.operators import busy as B
from curbscope.operators import features as FT
from curbscope.operators import patrol as P
from curbscope.operators import periods as PD
from curbscope.operators import score as SC
from curbscope.operators import trend as TR
from curbscope.operators import views as V
from curbscope.operators.clean import add_hex_id, clean_violations, quality_counts
from curbscope.operators.rollup import cell_rollup
from curbscope.operators.tier import label_clusters, tier_invariants
from curbscope.plans.build import HOTSPOT_COLUMNS, build_hotspot_table, materialise_rollup
from curbscope.sources.clean_table import read_clean
from curbscope.sources.events import violations_raw
from curbscope.sources.violations import limit_rows, read_violations

RESOLUTION = 9

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


# ---------------------------------------------------------------------------
# shared lazy inputs
# ---------------------------------------------------------------------------
def records(spark: SparkSession, sf_dir: str, resolution: int = RESOLUTION) -> DataFrame:
    return add_hex_id(clean_violations(violations_raw(spark, sf_dir)), resolution)


def rollup(spark: SparkSession, sf_dir: str, resolution: int = RESOLUTION) -> DataFrame:
    """The cell rollup, materialised once (records are scanned one time even
    when a query reads the rollup in several sub-plans)."""
    return materialise_rollup(records(spark, sf_dir, resolution))


def part(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    """The rollup of a few kinds, for queries that read it once: nothing is
    materialised and no other kind is made."""
    return cell_rollup(records(spark, sf_dir), kinds)


# ---------------------------------------------------------------------------
# scans and cleaning
# ---------------------------------------------------------------------------
@register("scan_violations")
def q_scan_violations(spark, sf_dir):
    return violations_raw(spark, sf_dir)


@register("clean_violations")
def q_clean_violations(spark, sf_dir):
    return clean_violations(violations_raw(spark, sf_dir)).select(
        "id", "latitude", "longitude", "vehicle_type", "police_station",
        "junction_name", "severity", "hour", "weekday", "date", "at_junction")


@register("hex_bin")
def q_hex_bin(spark, sf_dir):
    return (records(spark, sf_dir).groupBy("hex_id")
            .agg(F.count(F.lit(1)).alias("n")))


# ---------------------------------------------------------------------------
# features
# ---------------------------------------------------------------------------
@register("busy_hours")
def q_busy_hours(spark, sf_dir):
    hours = records(spark, sf_dir).groupBy("hour").agg(F.count(F.lit(1)).alias("n"))
    return B.busy_hours_from_counts(hours)


@register("hotspot_features")
def q_hotspot_features(spark, sf_dir):
    return FT.hotspot_features(rollup(spark, sf_dir))


# ---------------------------------------------------------------------------
# more scans and scalar functions
# ---------------------------------------------------------------------------
SCAN_LIMIT_ROWS = 1000
PATROL_OFFICERS, PATROL_HOURS = 5, 8
WHATIF_WEIGHTS = (10, 40, 30, 20)
VIEW_TIERS = ["Critical", "High", "Medium"]
STABLE_DIGITS = 9   # means of doubles depend on summation order; compare at 1e-9


def stable(c):
    return rint_round(c, STABLE_DIGITS)


@register("scan_limit")
def q_scan_limit(spark, sf_dir):
    raw = limit_rows(violations_raw(spark, sf_dir), SCAN_LIMIT_ROWS,
                     order_by=F.col("id").cast("long"))
    return clean_violations(raw).select("id", "severity", "hour", "weekday", "date", "at_junction")


@register("parse_tags")
def q_parse_tags(spark, sf_dir):
    raw = violations_raw(spark, sf_dir)
    tags = parse_tags(F.col("violation_type"))
    return raw.select("id", "violation_type", F.to_json(tags).alias("tags_json"),
                      F.size(tags).alias("n_tags"))


@register("record_severity")
def q_record_severity(spark, sf_dir):
    raw = violations_raw(spark, sf_dir)
    return raw.select("id", record_severity(parse_tags(F.col("violation_type"))).alias("severity"))


@register("temporal_features")
def q_temporal_features(spark, sf_dir):
    return clean_violations(violations_raw(spark, sf_dir)).select(
        "id", "created_ist", "hour", "weekday", "date")


@register("hex_bin_res")
def q_hex_bin_res(spark, sf_dir):
    """Cells at resolutions 7, 8 and 10 from one scan: each record carries
    its three cell ids, exploded into (resolution, hex_id) before one
    partial-aggregated count."""
    from curbscope.functions.grid import hex_cell_id

    clean = clean_violations(violations_raw(spark, sf_dir))
    lat, lon = F.col("latitude"), F.col("longitude")
    cells = F.array(*[F.struct(F.lit(r).alias("resolution"), hex_cell_id(lat, lon, r).alias("hex_id"))
                      for r in (7, 8, 10)])
    return (clean.select(F.inline(cells)).groupBy("resolution", "hex_id")
            .agg(F.count(F.lit(1)).alias("n")))


# ---------------------------------------------------------------------------
# rollup-level aggregates
# ---------------------------------------------------------------------------
@register("observation_span")
def q_observation_span(spark, sf_dir):
    return B.observation_days(part(spark, sf_dir, "day"))


@register("dominant_mode")
def q_dominant_mode(spark, sf_dir):
    return FT.dominant_values(part(spark, sf_dir, "station", "vehicle"))


@register("tag_breakdown")
def q_tag_breakdown(spark, sf_dir):
    return FT.tag_breakdown_long(part(spark, sf_dir, "tag"))


@register("tag_breakdown_sorted")
def q_tag_breakdown_sorted(spark, sf_dir):
    return V.tag_breakdown_sorted(part(spark, sf_dir, "tag"))


def weekly(spark, sf_dir):
    """Records per (cell, Monday week), counted from the records."""
    return (records(spark, sf_dir).groupBy("hex_id", B.week_start(F.col("date")).alias("week"))
            .agg(F.count(F.lit(1)).alias("count")))


@register("weekly_counts")
def q_weekly_counts(spark, sf_dir):
    return weekly(spark, sf_dir)


@register("growth_trend")
def q_growth_trend(spark, sf_dir):
    return TR.growth_trend(weekly(spark, sf_dir))


@register("forecast_all")
def q_forecast_all(spark, sf_dir):
    return TR.forecast_all(weekly(spark, sf_dir))


@register("history_forecast")
def q_history_forecast(spark, sf_dir):
    return TR.history_forecast(weekly(spark, sf_dir))


@register("weekday_hour_pivot")
def q_weekday_hour_pivot(spark, sf_dir):
    return V.weekday_hour_pivot(part(spark, sf_dir, "slot"))


@register("tag_mix")
def q_tag_mix(spark, sf_dir):
    return V.tag_mix(part(spark, sf_dir, "tag"))


@register("hourly_density")
def q_hourly_density(spark, sf_dir):
    return V.hourly_density(part(spark, sf_dir, "slot"))


@register("hourly_totals")
def q_hourly_totals(spark, sf_dir):
    r = rollup(spark, sf_dir)
    return V.hourly_totals(r, B.busy_hours(r))


@register("profile_clean")
def q_profile_clean(spark, sf_dir):
    prof = V.profile_clean(clean_violations(violations_raw(spark, sf_dir)))
    return prof.select("column", "count", *[stable(F.col(c)).alias(c) for c in
                                            ("mean", "std", "min", "p25", "p50", "p75", "max")])


# ---------------------------------------------------------------------------
# the cell table and everything built on it
# ---------------------------------------------------------------------------
def build(spark, sf_dir, tiering="threshold"):
    return build_hotspot_table(records(spark, sf_dir), tiering=tiering, hexed=True)


def hot(spark, sf_dir):
    """Cell table with the deterministic stand-in tier (oracle-checkable)."""
    return build(spark, sf_dir).hotspots


@register("percentile_scores")
def q_percentile_scores(spark, sf_dir):
    return hot(spark, sf_dir).select("hex_id", *SC.SCORE_SOURCES)


@register("cis_scores")
def q_cis_scores(spark, sf_dir):
    return hot(spark, sf_dir).select("hex_id", "congestion_impact_score")


@register("impact_flow")
def q_impact_flow(spark, sf_dir):
    return hot(spark, sf_dir).select("hex_id", "capacity_loss_pct", "shockwave_queue_km",
                                     "effective_speed_kmh")


@register("impact_cost")
def q_impact_cost(spark, sf_dir):
    return hot(spark, sf_dir).select("hex_id", "daily_delay_cost_inr", "annual_delay_cost_inr")


@register("recommended_action")
def q_recommended_action(spark, sf_dir):
    return V.with_action(hot(spark, sf_dir)).select("hex_id", "recommended_action")


VIEW_COLUMNS = ["hex_id", "dominant_station", "tier", "violation_count",
                "congestion_impact_score"]


@register("hotspot_view")
def q_hotspot_view(spark, sf_dir):
    return V.hotspot_view(hot(spark, sf_dir), VIEW_TIERS).select(*VIEW_COLUMNS)


@register("hotspot_lookup")
def q_hotspot_lookup(spark, sf_dir):
    h = hot(spark, sf_dir)
    first = V.hotspot_options(h, 1)
    return V.hotspot_lookup(h, first).select(
        "hex_id", "violation_count", "congestion_impact_score", "tier", "growth_rate",
        "capacity_loss_pct", "shockwave_queue_km", "effective_speed_kmh",
        "daily_delay_cost_inr", "annual_delay_cost_inr")


@register("hotspot_options")
def q_hotspot_options(spark, sf_dir):
    return V.hotspot_options(hot(spark, sf_dir))


@register("map_layer")
def q_map_layer(spark, sf_dir):
    return V.map_layer(hot(spark, sf_dir)).drop("latitude", "longitude")


@register("map_center")
def q_map_center(spark, sf_dir):
    c = V.map_center(hot(spark, sf_dir))
    return c.select(stable(F.col("center_lat")).alias("center_lat"),
                    stable(F.col("center_lon")).alias("center_lon"))


@register("priority_list")
def q_priority_list(spark, sf_dir):
    return V.priority_list(hot(spark, sf_dir)).select(
        "hex_id", "dominant_station", "violation_count", "congestion_impact_score", "tier",
        "recommended_action")


@register("priority_report")
def q_priority_report(spark, sf_dir):
    return V.priority_report(hot(spark, sf_dir))


@register("filter_options")
def q_filter_options(spark, sf_dir):
    return V.filter_options(hot(spark, sf_dir))


@register("kpis")
def q_kpis(spark, sf_dir):
    b = build(spark, sf_dir)
    k = V.kpis(b.hotspots, b.rollup, b.busy)
    return k.withColumn("avg_cis", stable(F.col("avg_cis")))


@register("patrol_schedule")
def q_patrol_schedule(spark, sf_dir):
    return P.patrol_schedule(hot(spark, sf_dir), PATROL_OFFICERS, PATROL_HOURS)


@register("patrol_by_station")
def q_patrol_by_station(spark, sf_dir):
    return P.patrol_by_station(hot(spark, sf_dir), PATROL_OFFICERS, PATROL_HOURS)


@register("patrol_summary")
def q_patrol_summary(spark, sf_dir):
    h = hot(spark, sf_dir)
    s = P.patrol_summary(P.patrol_schedule(h, PATROL_OFFICERS, PATROL_HOURS), h,
                         PATROL_OFFICERS, PATROL_HOURS)
    return s.select("assigned", "total_cis", "daily_cost_prevented", "budget",
                    stable(F.col("random_cis")).alias("random_cis"),
                    stable(F.col("pct_better")).alias("pct_better"))


@register("tier_labels")
def q_tier_labels(spark, sf_dir):
    lab = label_clusters(hot(spark, sf_dir))
    return lab.select("cluster", stable(F.col("mean_cis")).alias("mean_cis"),
                      "cluster_rank", "tier")


@register("whatif_rank")
def q_whatif_rank(spark, sf_dir):
    return SC.whatif_first(hot(spark, sf_dir), *WHATIF_WEIGHTS)


@register("whatif_movers")
def q_whatif_movers(spark, sf_dir):
    return SC.whatif_movers(SC.whatif_ranks(hot(spark, sf_dir), *WHATIF_WEIGHTS))


CHECKED_COLUMNS = [c for c in HOTSPOT_COLUMNS if c not in ("cluster", "tier", "tag_breakdown")]


@register("hotspot_table")
def q_hotspot_table(spark, sf_dir):
    """The full KMeans build; the tier/cluster/map columns are left out of
    the checked projection (see ``tier_hotspots`` for the tiers)."""
    return build(spark, sf_dir, tiering="kmeans").hotspots.select(*CHECKED_COLUMNS)


@register("tier_hotspots")
def q_tier_hotspots(spark, sf_dir):
    return build(spark, sf_dir, tiering="kmeans").hotspots.select(
        "hex_id", "cluster", "tier", "congestion_impact_score")


@register("hotspot_export")
def q_hotspot_export(spark, sf_dir):
    """Write the CSV export (map dropped) to the checkpoint folder and read
    it back with the table's types."""
    import uuid

    from curbscope.session import ensure_checkpoint_dir
    from curbscope.sources.sinks import export_hotspots_csv, read_hotspots_csv

    h = hot(spark, sf_dir)
    path = ensure_checkpoint_dir(spark).rstrip("/") + f"/export-{uuid.uuid4().hex}"
    export_hotspots_csv(h, path)
    return read_hotspots_csv(spark, path, h)


@register("stream_hex_counts")
def q_stream_hex_counts(spark, sf_dir):
    """Records per cell from the incremental path: ``events`` read as a file
    stream, one partial rollup per micro-batch, partial rollups summed."""
    import uuid

    from curbscope.operators.rollup import kind
    from curbscope.session import ensure_checkpoint_dir
    from curbscope.streaming.ingest import combined_rollup, event_stream, start_rollup_stream

    base = ensure_checkpoint_dir(spark).rstrip("/") + f"/stream-{uuid.uuid4().hex}"
    q = start_rollup_stream(event_stream(spark, sf_dir), base + "/rollup", base + "/state")
    q.awaitTermination()
    return (kind(combined_rollup(spark, base + "/rollup"), "day").groupBy("hex_id")
            .agg(F.sum("n").alias("n")))


@register("scan_violations_csv")
def q_scan_violations_csv(spark, sf_dir):
    """The CSV scan path: raw records written as a header CSV (RFC 4180
    quoting, edge whitespace kept) to the checkpoint folder, then read back
    with ``read_violations_csv`` (header check, typed schema, missing-value
    spellings)."""
    import uuid

    from curbscope.session import ensure_checkpoint_dir
    from curbscope.sources.violations import read_violations_csv

    path = ensure_checkpoint_dir(spark).rstrip("/") + f"/raw-csv-{uuid.uuid4().hex}"
    (violations_raw(spark, sf_dir).write.option("header", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .csv(path))
    return read_violations_csv(spark, path)


@register("hotspot_export_parquet")
def q_hotspot_export_parquet(spark, sf_dir):
    """The Parquet sink keeps every column, the tag map included; the map
    is checked through its entry count, everything else as is."""
    import uuid

    from curbscope.session import ensure_checkpoint_dir
    from curbscope.sources.sinks import export_hotspots_parquet

    path = ensure_checkpoint_dir(spark).rstrip("/") + f"/export-pq-{uuid.uuid4().hex}"
    export_hotspots_parquet(hot(spark, sf_dir), path)
    back = spark.read.parquet(path)
    return back.select(*CHECKED_COLUMNS, "cluster", "tier",
                       F.size("tag_breakdown").alias("n_tags"),
                       F.aggregate(F.map_values("tag_breakdown"), F.lit(0).cast("long"),
                                   lambda a, b: a + b).alias("tag_total"))


@register("priority_report_display")
def q_priority_report_display(spark, sf_dir):
    return V.priority_report_display(V.priority_report(hot(spark, sf_dir)))


@register("weekday_hour_counts")
def q_weekday_hour_counts(spark, sf_dir):
    return V.weekday_hour_counts(part(spark, sf_dir, "slot"))


@register("forecast_reference_labels")
def q_forecast_reference_labels(spark, sf_dir):
    """Forecasts dated like the reference's weekly series (Sundays 13 and 20
    days after the last history Monday)."""
    return TR.forecast_all(weekly(spark, sf_dir), label="reference")


VIEW_STATIONS = ["PS-1", "PS-2"]
POOL_TIERS = ["Critical", "High"]


@register("hotspot_view_stations")
def q_hotspot_view_stations(spark, sf_dir):
    return V.hotspot_view(hot(spark, sf_dir), None, VIEW_STATIONS).select(*VIEW_COLUMNS)


@register("patrol_station_pool")
def q_patrol_station_pool(spark, sf_dir):
    """With a station filter the patrol pool is the filtered view, tier
    filter included."""
    return P.patrol_schedule(hot(spark, sf_dir), PATROL_OFFICERS, PATROL_HOURS,
                             stations=VIEW_STATIONS, tiers=POOL_TIERS)


@register("quality_counts")
def q_quality_counts(spark, sf_dir):
    """Records that cleaning leaves out or reads leniently, by reason."""
    return quality_counts(violations_raw(spark, sf_dir))


def written_raw(spark, sf_dir) -> str:
    """Raw records as CSV files in the shared folder, by id: files of
    consecutive ids, as many as the session's shuffle partitions give."""
    import uuid

    from curbscope.session import ensure_checkpoint_dir

    path = ensure_checkpoint_dir(spark).rstrip("/") + f"/ordered-csv-{uuid.uuid4().hex}"
    raw = violations_raw(spark, sf_dir)
    (raw.repartitionByRange(F.col("id").cast("long")).sortWithinPartitions(F.col("id").cast("long"))
     .write.option("header", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return path


@register("scan_first_rows")
def q_scan_first_rows(spark, sf_dir):
    """First rows in file order of a folder of CSV files, no sort key."""
    path = written_raw(spark, sf_dir)
    return read_violations(spark, path, nrows=SCAN_LIMIT_ROWS).select("id", "latitude", "police_station")


@register("tier_invariants")
def q_tier_invariants(spark, sf_dir):
    """What holds for any right tiering: every cell has a tier, at most k
    clusters, tiers in the order of their mean scores, and no cell is closer
    to another cluster's centroid than to its own."""
    return tier_invariants(build(spark, sf_dir, tiering="kmeans").hotspots)


@register("cached_build")
def q_cached_build(spark, sf_dir):
    """The cached build asked for twice: the second time the same tables."""
    from curbscope.plans import cache

    path = written_raw(spark, sf_dir)
    first, second = (cache.cached_build(spark, path) for _ in range(2))
    cells = second.hotspots.select("hex_id", "violation_count", "congestion_impact_score")
    return cells.withColumn("reused", F.lit(first is second))


# ---------------------------------------------------------------------------
# records in folders by date
# ---------------------------------------------------------------------------
PERIOD = ("2024-01-08", "2024-01-14")
BEFORE, AFTER = ("2024-01-01", "2024-01-07"), ("2024-01-22", "2024-01-28")
PEAK_DAYS = 3


def dated(spark, sf_dir) -> str:
    """The clean records, written by date to the shared folder."""
    import uuid

    from curbscope.session import ensure_checkpoint_dir
    from curbscope.sources.clean_table import write_clean

    path = ensure_checkpoint_dir(spark).rstrip("/") + f"/clean-{uuid.uuid4().hex}"
    write_clean(records(spark, sf_dir), path)
    return path


@register("period_hours")
def q_period_hours(spark, sf_dir):
    """Busy hours of one week; only its seven folders are read."""
    return PD.period_hours(read_clean(spark, dated(spark, sf_dir), *PERIOD))


@register("period_cells")
def q_period_cells(spark, sf_dir):
    return PD.period_cells(read_clean(spark, dated(spark, sf_dir), *PERIOD))


@register("peak_day_slots")
def q_peak_day_slots(spark, sf_dir):
    """Hourly course of the busiest days, found by the query itself."""
    return PD.peak_day_slots(read_clean(spark, dated(spark, sf_dir)), PEAK_DAYS)


@register("period_change")
def q_period_change(spark, sf_dir):
    return PD.period_change(read_clean(spark, dated(spark, sf_dir)), BEFORE, AFTER)


@register("cached_refresh")
def q_cached_refresh(spark, sf_dir):
    """The cached build of a folder that gains files between two requests:
    the second reads the new ones only, a third none."""
    import uuid

    from curbscope.plans import cache
    from curbscope.session import ensure_checkpoint_dir

    path = ensure_checkpoint_dir(spark).rstrip("/") + f"/growing-{uuid.uuid4().hex}"
    raw = violations_raw(spark, sf_dir)
    late = F.col("id").cast("long") % 5 == 0

    def add(rows: DataFrame) -> None:
        rows.write.mode("append").option("header", True).option("escape", '"').option(
            "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)

    add(raw.where(~late))
    cache.cached_build(spark, path)
    own = cache.source(spark, path)
    old = set(own.known)
    add(raw.where(late))
    build = cache.cached_build(spark, path)
    opened = set(own.last_read)
    again = cache.cached_build(spark, path)
    cells = build.hotspots.select("hex_id", "violation_count", "congestion_impact_score")
    only_new = bool(opened) and not opened & old
    return cells.withColumns({"only_new": F.lit(only_new), "reused": F.lit(again is build and not own.last_read)})


#: Three origins over the span of the records, for cells around several cities.
CITIES = [City("north", 13.02, 77.60), City("west", 12.93, 77.54), City("south", 12.90, 77.66)]


@register("hex_bin_cities")
def q_hex_bin_cities(spark, sf_dir):
    """Records per cell on the grid of the nearest of several cities."""
    return (add_city_cells(clean_violations(violations_raw(spark, sf_dir)), CITIES, 8).groupBy("hex_id")
            .agg(F.count(F.lit(1)).alias("n")))
