"""Weekly growth trend, per-cell forecast and history + forecast series.

The OLS fit of weekly counts on the ordinal week index ``x = 0..n-1`` (gaps
collapsed) uses exact integer sums: ``b1 = (n Sxy - Sx Sy) / (n Sxx - Sx^2)``
and ``b0 = (Sy - b1 Sx) / n``. The sums are ordinary partial-aggregable
aggregates, so every cell is fitted in one distributed job instead of one
call per cell. The weekly table has one row per (cell, non-empty week), so
the ``row_number`` window per cell holds at most ~52 rows per year.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ols_sums(weekly: DataFrame) -> DataFrame:
    """(hex_id, n, sx, sxx, sxy, sy, last_week) from (hex_id, week, count)."""
    x = F.row_number().over(Window.partitionBy("hex_id").orderBy("week")) - 1
    with_x = weekly.withColumn("x", x.cast("long"))
    return with_x.groupBy("hex_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("x").alias("sx"),
        F.sum(F.col("x") * F.col("x")).alias("sxx"),
        F.sum(F.col("x") * F.col("count")).alias("sxy"),
        F.sum("count").alias("sy"),
        F.max("week").alias("last_week"),
    )


def _slope():
    n, sx, sxx, sxy, sy = (F.col(c) for c in ("n", "sx", "sxx", "sxy", "sy"))
    num = n * sxy - sx * sy
    den = n * sxx - sx * sx
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den.cast("double"))


def growth_trend(weekly: DataFrame, min_weeks: int = 3) -> DataFrame:
    """(hex_id, growth_rate): OLS slope / mean weekly count; 0.0 when the
    cell has fewer than ``min_weeks`` non-empty weeks."""
    s = ols_sums(weekly)
    mean = F.col("sy").cast("double") / F.col("n").cast("double")
    growth = F.when((F.col("n") < min_weeks) | (F.col("sy") == 0), F.lit(0.0)) \
        .otherwise(_slope() / mean)
    return s.select("hex_id", growth.alias("growth_rate"))


def forecast_all(weekly: DataFrame, weeks_ahead: int = 2, label: str = "week_start",
                 min_weeks: int = 3, hex_ids: list[str] | None = None) -> DataFrame:
    """Next ``weeks_ahead`` weekly counts for every cell.

    Cells with >= ``min_weeks`` weeks extend the OLS line (clipped at 0);
    others repeat their mean; ``hex_ids`` restricts the output to some
    cells (the drill-down form). ``label='week_start'`` dates forecasts on the
    following Mondays (same axis as history); ``label='reference'`` on the
    Sundays 13 and 20 days after the last history Monday.
    Output: hex_id, step, week, forecast_count.
    """
    if label not in ("week_start", "reference"):
        raise ValueError("label must be 'week_start' or 'reference'")
    if hex_ids is not None:
        weekly = weekly.filter(F.col("hex_id").isin(list(hex_ids)))
    s = ols_sums(weekly)
    b1 = _slope()
    n = F.col("n").cast("double")
    b0 = (F.col("sy").cast("double") - b1 * F.col("sx").cast("double")) / n
    steps = s.select("*", b1.alias("b1"), b0.alias("b0"),
                     F.explode(F.sequence(F.lit(1), F.lit(int(weeks_ahead)))).alias("step"))
    x = (F.col("n") - 1 + F.col("step")).cast("double")
    line = F.greatest(F.col("b1") * x + F.col("b0"), F.lit(0.0))
    mean = F.greatest(F.col("sy").cast("double") / n, F.lit(0.0))
    shift = F.col("step") * 7 + (6 if label == "reference" else 0)
    return steps.select(
        "hex_id", "step",
        F.date_add(F.col("last_week"), shift).alias("week"),
        F.when(F.col("n") < min_weeks, mean).otherwise(line).alias("forecast_count"),
    )


def history_forecast(weekly: DataFrame, weeks_ahead: int = 2,
                     label: str = "week_start") -> DataFrame:
    """Union of weekly history and forecast, pivoted by series type:
    (hex_id, week, history, forecast)."""
    hist = weekly.select("hex_id", "week", F.col("count").cast("double").alias("count"),
                         F.lit("history").alias("type"))
    fc = forecast_all(weekly, weeks_ahead, label).select(
        "hex_id", "week", F.col("forecast_count").alias("count"), F.lit("forecast").alias("type"))
    return (hist.unionByName(fc).groupBy("hex_id", "week")
            .pivot("type", ["history", "forecast"]).agg(F.avg("count")))
