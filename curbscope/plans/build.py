"""End-to-end hotspot build: records -> cell rollup -> features -> trend
-> scores -> tiers -> impact -> cost. The table itself is not sorted: views
and sinks sort what they show.

Materialisation points (written to ``spark.checkpoint.dir``, so a lost
executor never sends the job back to the raw scan):

* the cell rollup -- every later shuffle moves rollup rows (bounded by
  cells x keys), never records. It is dealt out by cell once: features,
  weekly trend and tag map aggregate and join where their rows lie;
* the feature table, which the rank helpers read several times;
* the scored table, which tiers and every view read: the rank joins run
  once, however many consumers there are.

All are bounded by the number of cells, not by the number of records.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbscope.operators.busy import busy_hours, n_days_scalar, weekly_counts
from curbscope.operators.clean import add_hex_id
from curbscope.operators.features import hotspot_features, tag_breakdown_map
from curbscope.operators.impact import delay_cost, flow_impact
from curbscope.operators.rollup import cell_rollup
from curbscope.operators.score import score_hotspots
from curbscope.operators.tier import threshold_tiers, tier_hotspots
from curbscope.operators.trend import growth_trend
from curbscope.plans.tables import bucketed
from curbscope.session import ensure_checkpoint_dir

HOTSPOT_COLUMNS = [
    "hex_id", "violation_count", "severity_weighted_count", "avg_severity",
    "junction_fraction", "busy_hour_fraction", "active_days", "latitude", "longitude",
    "dominant_station", "dominant_vehicle", "persistence_ratio", "tag_breakdown",
    "growth_rate", "score_severity", "score_junction", "score_busy_hour",
    "score_persistence", "congestion_impact_score", "cluster", "tier",
    "capacity_loss_pct", "shockwave_queue_km", "effective_speed_kmh",
    "daily_delay_cost_inr", "annual_delay_cost_inr",
]


@dataclass
class HotspotBuild:
    hotspots: DataFrame      # one row per cell, in no order
    busy: DataFrame          # (hour, n, cum_share)
    rollup: DataFrame        # the cell rollup (written by cell)


def materialise_rollup(hexed: DataFrame) -> DataFrame:
    return bucketed(cell_rollup(hexed), "hex_id")


def scored_cells(rollup: DataFrame, coverage: float = 0.5, min_weeks: int = 3,
                 busy: DataFrame | None = None) -> DataFrame:
    """Features + growth + tag map + percentile scores + CIS (no tier yet)."""
    if busy is None:
        busy = busy_hours(rollup, coverage)
    feats = hotspot_features(rollup, busy)
    trend = growth_trend(weekly_counts(rollup), min_weeks)
    cells = (feats.join(trend, "hex_id", "left")
             .withColumn("growth_rate", F.coalesce(F.col("growth_rate"), F.lit(0.0)))
             .join(tag_breakdown_map(rollup), "hex_id", "left"))
    ensure_checkpoint_dir(rollup.sparkSession)
    return score_hotspots(cells.checkpoint(eager=True)).checkpoint(eager=True)


def finish(tiered: DataFrame, rollup: DataFrame) -> DataFrame:
    out = delay_cost(flow_impact(tiered), n_days_scalar(rollup))
    return out.select(*HOTSPOT_COLUMNS)


def build_hotspot_table(records: DataFrame, resolution: int = 9, k_tiers: int = 4,
                        coverage: float = 0.5, min_weeks: int = 3,
                        tiering: str = "kmeans", seed: int = 42, n_init: int = 10,
                        hexed: bool = False) -> HotspotBuild:
    """Build the ranked cell table from clean records.

    ``tiering='kmeans'`` (default) clusters cells with ``operators.kmeans``;
    ``'threshold'`` uses the deterministic CIS bands of ``threshold_tiers``.
    """
    hx = records if hexed else add_hex_id(records, resolution)
    return build_from_rollup(materialise_rollup(hx), k_tiers, coverage, min_weeks,
                             tiering, seed, n_init)


def build_from_rollup(rollup: DataFrame, k_tiers: int = 4, coverage: float = 0.5,
                      min_weeks: int = 3, tiering: str = "kmeans", seed: int = 42,
                      n_init: int = 10) -> HotspotBuild:
    """Build the cell table from an existing (e.g. incrementally ingested)
    cell rollup; nothing here touches records."""
    busy = busy_hours(rollup, coverage)
    scored = scored_cells(rollup, coverage, min_weeks, busy)
    if tiering == "kmeans":
        tiered = tier_hotspots(scored, k=k_tiers, seed=seed, n_init=n_init)
    elif tiering == "threshold":
        tiered = threshold_tiers(scored)
    else:
        raise ValueError("tiering must be 'kmeans' or 'threshold'")
    return HotspotBuild(finish(tiered, rollup), busy, rollup)
