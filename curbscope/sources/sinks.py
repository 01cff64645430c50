"""Sinks for the hotspot table.

CSV cannot hold the ``tag_breakdown`` map, so the CSV export drops it (the
whole, unfiltered table otherwise); the Parquet sink keeps every column.
Both write one part file per task -- no ``coalesce(1)`` funnel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from curbscope.operators.score import cis_order


#: Quotes are doubled and blanks kept, so that text comes back as it was.
CSV_OPTIONS = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False,
               "ignoreTrailingWhiteSpace": False}


def _sorted(hotspots: DataFrame) -> DataFrame:
    """By CIS, as the table is read; part files follow that order."""
    if "congestion_impact_score" not in hotspots.columns:
        return hotspots
    return hotspots.orderBy(*cis_order())


def export_hotspots_csv(hotspots: DataFrame, path: str, mode: str = "overwrite") -> None:
    _sorted(hotspots.drop("tag_breakdown")).write.mode(mode).options(**CSV_OPTIONS).csv(path)


def export_hotspots_parquet(hotspots: DataFrame, path: str, mode: str = "overwrite") -> None:
    _sorted(hotspots).write.mode(mode).parquet(path)


def read_hotspots_csv(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """Read an export back with the column types of ``like`` (no inference)."""
    fields = [f for f in like.schema.fields if f.name != "tag_breakdown"]
    return spark.read.schema(T.StructType(fields)).options(**CSV_OPTIONS).csv(path)
