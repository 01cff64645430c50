"""Closed-form traffic impact and delay cost per cell (projections only).

Operation order follows the reference formulas so doubles agree:

* ``k = min(min(avg_severity / 3, 1) * (1 + junction_fraction * 0.5), 0.85)``
* ``capacity_loss_pct = round1(k * 100)``
* ``shockwave_queue_km = round2(capacity_loss_pct / 100 * 2.5 * persistence)``
  (from the *rounded* percentage)
* ``effective_speed_kmh = round1(40 * (1 - k))``
* ``daily = round0(count / max(n_days, 1) * 10 * (2.5 / 60) * (avg_sev / 1.5) * 50)``
* ``annual = 365 * daily``

``roundN`` is half-even on the scaled binary value (``rint``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbscope import schema as S
from curbscope.functions.numeric import clip, rint_round


def flow_impact(df: DataFrame) -> DataFrame:
    lit = F.lit
    obstruction = clip(F.col("avg_severity") / lit(S.OBSTRUCTION_SCALE), upper=1.0)
    boost = lit(1.0) + F.col("junction_fraction") * lit(S.JUNCTION_BOOST)
    k = clip(obstruction * boost, upper=S.MAX_DENSITY_FRACTION)
    df = df.withColumn("_k", k)
    df = df.withColumn("capacity_loss_pct", rint_round(F.col("_k") * lit(100.0), 1))
    df = df.withColumn("shockwave_queue_km", rint_round(
        F.col("capacity_loss_pct") / lit(100.0) * lit(S.QUEUE_KM_FACTOR)
        * F.col("persistence_ratio"), 2))
    df = df.withColumn("effective_speed_kmh",
                       rint_round(lit(S.FREE_FLOW_KMH) * (lit(1.0) - F.col("_k")), 1))
    return df.drop("_k")


def delay_cost(df: DataFrame, n_days: Column | int) -> DataFrame:
    """``n_days``: a literal or a scalar-subquery column (observation span)."""
    lit = F.lit
    days = F.greatest(n_days if isinstance(n_days, Column) else lit(int(n_days)), lit(1))
    daily_violations = clip(F.col("violation_count") / days, lower=0.0)
    vehicles = daily_violations * lit(float(S.VEHICLES_PER_VIOLATION))
    delay_hrs = (vehicles * lit(S.AVG_DELAY_MIN / 60)
                 * (F.col("avg_severity") / lit(S.SEVERITY_DELAY_SCALE)))
    daily = rint_round(delay_hrs * lit(S.DELAY_COST_PER_VEH_HR), 0).cast("long")
    df = df.withColumn("daily_delay_cost_inr", daily)
    return df.withColumn("annual_delay_cost_inr",
                         F.col("daily_delay_cost_inr") * lit(S.DAYS_PER_YEAR))
