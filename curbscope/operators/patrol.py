"""Budgeted greedy patrol allocation without a row loop.

The greedy scan (cells by CIS desc; Critical costs 2 officer-hours, others
1; a cell that no longer fits is skipped; stop when the budget B is spent)
has a closed form because costs are 1 or 2:

* every cell whose cumulative cost is <= B is taken;
* if the first cell that does not fit leaves exactly one hour, the first
  later non-Critical cell is taken too.

Only two bounded top-k sets can matter: the top B cells overall and the top
B+1 non-Critical cells (both ``TakeOrderedAndProject``, each task keeping
k rows). A window over those <= 2B+1 rows finishes the job. The per-station
form uses ``row_number() <= k`` filters, which Spark turns into a partial
per-group limit before the shuffle, so a station owning a third of all
cells still ships only k rows per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curbscope import schema as S
from curbscope.functions.numeric import rint_round


def _order():
    return [F.col("congestion_impact_score").desc(), F.col("hex_id").asc()]


def _cost():
    return F.when(F.col("tier") == "Critical", F.lit(S.PATROL_COST_CRITICAL)) \
        .otherwise(F.lit(S.PATROL_COST_OTHER))


_COLUMNS = ["hex_id", "dominant_station", "tier", "congestion_impact_score",
            "capacity_loss_pct", "daily_delay_cost_inr"]


def filter_pool(hotspots: DataFrame, stations: list[str] | None = None,
                tiers: list[str] | None = None) -> DataFrame:
    """The patrol pool: with a station filter it is the filtered view (tier
    filter included: ``None`` = all tiers, ``[]`` = none); without one it is
    every cell, whatever the tier filter."""
    if not stations:
        return hotspots
    pool = hotspots.filter(F.col("dominant_station").isin(list(stations)))
    if tiers is not None:
        pool = pool.filter(F.col("tier").isin(list(tiers))) if tiers else pool.limit(0)
    return pool


def _select(cands: DataFrame, budget: int, partition: list[str]) -> DataFrame:
    w = Window.partitionBy(*partition).orderBy(*_order())
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*partition)
    c = cands.withColumns({"_cost": _cost(), "_pos": F.row_number().over(w)})
    c = c.withColumn("_cum", F.sum("_cost").over(run))
    over = F.col("_cum") > budget
    c = c.withColumns({
        "_j": F.min(F.when(over, F.col("_pos"))).over(whole),
        # hours left when the first overflowing cell is reached (later
        # overflowing rows have larger prefixes, so this is the maximum)
        "_left": F.max(F.when(over, F.lit(budget) - (F.col("_cum") - F.col("_cost")))).over(whole),
    })
    extra_pos = F.min(F.when((F.col("_pos") > F.col("_j")) & (F.col("_cost") == 1)
                             & (F.col("_left") == 1), F.col("_pos"))).over(whole)
    c = c.withColumn("_extra", extra_pos)
    chosen = c.filter((F.col("_cum") <= budget) | (F.col("_pos") == F.col("_extra")))
    prio = F.row_number().over(Window.partitionBy(*partition).orderBy(*_order()))
    return chosen.select(
        *partition, prio.alias("priority"), "hex_id",
        F.col("dominant_station").alias("station"), "tier",
        rint_round(F.col("congestion_impact_score"), 1).alias("cis"),
        F.col("_cost").alias("officers"), F.col("_cost").alias("hours"),
        rint_round(F.coalesce(F.col("capacity_loss_pct"), F.lit(0.0)), 1).alias("lane_loss_pct"),
        F.coalesce(F.col("daily_delay_cost_inr"), F.lit(0)).cast("long").alias("est_daily_cost_inr"),
    )


def patrol_schedule(hotspots: DataFrame, n_officers: int = 5, shift_hours: int = 8,
                    stations: list[str] | None = None,
                    tiers: list[str] | None = None) -> DataFrame:
    budget = int(n_officers) * int(shift_hours)
    pool = filter_pool(hotspots, stations, tiers).select(*_COLUMNS)
    if budget <= 0:
        return _select(pool.limit(0), budget, [])
    top = pool.orderBy(*_order()).limit(budget)
    top_other = pool.filter(F.col("tier") != "Critical").orderBy(*_order()).limit(budget + 1)
    cands = top.unionByName(top_other).distinct()
    return _select(cands, budget, [])


def patrol_by_station(hotspots: DataFrame, n_officers: int = 5,
                      shift_hours: int = 8) -> DataFrame:
    """One schedule per dominant station (each station gets the budget)."""
    budget = int(n_officers) * int(shift_hours)
    pool = hotspots.select(*_COLUMNS).withColumn("_st", F.col("dominant_station"))
    by_station = Window.partitionBy("_st").orderBy(*_order())
    top = pool.withColumn("_r", F.row_number().over(by_station)).filter(F.col("_r") <= budget)
    other = pool.filter(F.col("tier") != "Critical")
    top_other = other.withColumn("_r", F.row_number().over(by_station)) \
        .filter(F.col("_r") <= budget + 1)
    cands = top.drop("_r").unionByName(top_other.drop("_r")).distinct()
    return _select(cands, budget, ["_st"]).drop("_st")


def patrol_summary(schedule: DataFrame, hotspots: DataFrame, n_officers: int = 5,
                   shift_hours: int = 8) -> DataFrame:
    """One row: assigned cells, CIS recovered (sum of the 1-decimal values),
    daily cost prevented, the random-deployment baseline
    ``mean(CIS of all cells) * min(budget, #cells)`` and % improvement."""
    budget = int(n_officers) * int(shift_hours)
    stats = hotspots.agg(F.avg("congestion_impact_score").alias("m"),
                         F.count(F.lit(1)).alias("c"))
    mean_cis = stats.select("m").scalar()
    n_cells = stats.select("c").scalar()
    s = schedule.agg(
        F.count(F.lit(1)).alias("assigned"),
        rint_round(F.coalesce(F.sum("cis"), F.lit(0.0)), 1).alias("total_cis"),
        F.coalesce(F.sum("est_daily_cost_inr"), F.lit(0)).cast("long").alias("daily_cost_prevented"),
    )
    random_cis = mean_cis * F.least(F.lit(budget).cast("long"), n_cells)
    s = s.withColumn("random_cis", random_cis)
    pct = F.when(F.col("random_cis") > 0,
                 (F.col("total_cis") - F.col("random_cis")) / F.col("random_cis") * F.lit(100.0))
    return s.withColumn("pct_better", pct).withColumn("budget", F.lit(budget))
