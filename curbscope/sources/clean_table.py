"""The clean records as a Parquet table in folders by date.

Readers that ask for some dates open only their folders: a range of dates is
a partition filter, and days that are known only when the query runs (the
busiest ones) prune the scan dynamically.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_clean(records: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Clean records (with ``hex_id``, if they have it) by date. Rows are
    rebalanced by date at run time: a date of very many records becomes
    several files of the session's advisory size, dates of few share a task.
    With ``mode="overwrite"`` only the dates written are replaced."""
    (records.hint("rebalance", F.col("date")).write.mode(mode)
     .option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path))


def read_clean(spark: SparkSession, path: str, first: dt.date | str | None = None,
               last: dt.date | str | None = None) -> DataFrame:
    """Records of the dates ``first`` to ``last`` (both included; open where
    ``None``), from their folders only."""
    rows = spark.read.parquet(path)
    day = F.col("date").cast("date")
    if first is not None:
        rows = rows.where(day >= F.lit(str(first)).cast("date"))
    if last is not None:
        rows = rows.where(day <= F.lit(str(last)).cast("date"))
    return rows
