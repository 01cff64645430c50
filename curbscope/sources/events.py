"""Raw violation records derived from the driver ``events`` table.

The driver tables carry no enforcement records, so the test and benchmark
input is a deterministic projection of ``events`` onto the 10-column raw
violation schema (see FIXTURES.md section 2). It is a pure projection: no
shuffle, column-pruned to ``event_id, ts, user_id, event_type`` at the scan.
``violations_raw_sql`` renders the identical rule set for the SQL oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


# --- fixed values: event type -> stringified violation list -----------------
EVENT_TAGS = {
    "click": '["WRONG PARKING","NO PARKING"]',
    "view": '["NO PARKING"]',
    "purchase": '["DOUBLE PARKING","RIDER NOT WEARING HELMET"]',
    "signup": '["PARKING ON FOOTPATH"]',
}
# "error" events by event_id % 4 (None = missing value)
ERROR_TAGS = ['["RIDER NOT WEARING HELMET"]', "WRONG PARKING", None,
              '["PARKING IN A MAIN ROAD"]']
VEHICLES = ["CAR", "SCOOTER", "AUTO", "BUS"]


def _pick(index: Column, values: list) -> Column:
    expr = None
    for i, v in enumerate(values):
        lit = F.lit(v).cast("string")
        expr = F.when(index == i, lit) if expr is None else expr.when(index == i, lit)
    return expr


def violations_from_events(events: DataFrame) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    lit = F.lit
    tags = None
    for etype, text in EVENT_TAGS.items():
        cond = F.col("event_type") == etype
        tags = F.when(cond, lit(text)) if tags is None else tags.when(cond, lit(text))
    tags = tags.when(F.col("event_type") == "error", _pick(e % 4, ERROR_TAGS))
    return events.select(
        e.cast("string").alias("id"),
        F.when(e % 101 == 0, lit(None).cast("double"))
         .otherwise(lit(12.90) + (u % 12).cast("double") * lit(0.012)
                    + (e % 7).cast("double") * lit(0.0004)).alias("latitude"),
        (lit(77.52) + ((u * 7) % 13).cast("double") * lit(0.013)
         + (e % 5).cast("double") * lit(0.0004)).alias("longitude"),
        lit(None).cast("string").alias("location"),
        F.when(e % 19 == 0, lit(None).cast("string"))
         .otherwise(_pick(e % 4, VEHICLES)).alias("vehicle_type"),
        tags.alias("violation_type"),
        lit(None).cast("string").alias("offence_code"),
        F.when(e % 211 == 0, lit(None).cast("string"))
         .when(e % 307 == 0, lit("not-a-date"))
         .otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), lit("+00")))
         .alias("created_datetime"),
        F.when(u % 17 == 0, lit(None).cast("string"))
         .otherwise(F.concat(lit("PS-"), (u % 10).cast("string"))).alias("police_station"),
        F.when(u % 3 == 0, lit(None).cast("string"))
         .when(u % 3 == 1, lit(" no junction "))
         .otherwise(F.concat(lit("BTP"), (u % 40).cast("string"))).alias("junction_name"),
    )


EVENT_COLUMNS = ["event_id", "ts", "user_id", "event_type"]


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan ``events``, pruned to the four columns the derivation uses."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(*EVENT_COLUMNS)


def violations_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw violation records for one scale-factor folder."""
    return violations_from_events(read_events(spark, sf_dir))


def violations_raw_sql(events: str = "events") -> str:
    """The same derivation as SQL text (oracle side)."""
    def d(v: float) -> str:
        return f"CAST('{v!r}' AS DOUBLE)"

    def pick(index: str, values: list) -> str:
        arms = " ".join(
            f"WHEN {index} = {i} THEN {'NULL' if v is None else repr_sql(v)}"
            for i, v in enumerate(values))
        return f"CASE {arms} END"

    tag_arms = " ".join(f"WHEN event_type = {repr_sql(k)} THEN {repr_sql(v)}"
                        for k, v in EVENT_TAGS.items())
    return f"""
SELECT
  CAST(event_id AS VARCHAR) AS id,
  CASE WHEN event_id % 101 = 0 THEN CAST(NULL AS DOUBLE)
       ELSE {d(12.90)} + CAST(user_id % 12 AS DOUBLE) * {d(0.012)}
            + CAST(event_id % 7 AS DOUBLE) * {d(0.0004)} END AS latitude,
  {d(77.52)} + CAST((user_id * 7) % 13 AS DOUBLE) * {d(0.013)}
    + CAST(event_id % 5 AS DOUBLE) * {d(0.0004)} AS longitude,
  CAST(NULL AS VARCHAR) AS location,
  CASE WHEN event_id % 19 = 0 THEN NULL ELSE {pick('event_id % 4', VEHICLES)} END AS vehicle_type,
  CASE {tag_arms} WHEN event_type = 'error' THEN {pick('event_id % 4', ERROR_TAGS)} END
    AS violation_type,
  CAST(NULL AS VARCHAR) AS offence_code,
  CASE WHEN event_id % 211 = 0 THEN NULL
       WHEN event_id % 307 = 0 THEN 'not-a-date'
       ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') || '+00' END AS created_datetime,
  CASE WHEN user_id % 17 = 0 THEN NULL
       ELSE 'PS-' || CAST(user_id % 10 AS VARCHAR) END AS police_station,
  CASE WHEN user_id % 3 = 0 THEN NULL
       WHEN user_id % 3 = 1 THEN ' no junction '
       ELSE 'BTP' || CAST(user_id % 40 AS VARCHAR) END AS junction_name
FROM {events}"""


def repr_sql(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"
