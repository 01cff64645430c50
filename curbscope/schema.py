"""Schemas and fixed domain values.

Values in the "fixed values" blocks below must stay exactly as written for
results to agree with the behaviour this library re-implements (tag weights,
labels, colours, action texts, thresholds, physical constants).
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Input / output schemas
# ---------------------------------------------------------------------------
# fixed values: the input contract's column names
RAW_COLUMNS = [
    "id", "latitude", "longitude", "location", "vehicle_type",
    "violation_type", "offence_code", "created_datetime",
    "police_station", "junction_name",
]

RAW_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("location", T.StringType()),
    T.StructField("vehicle_type", T.StringType()),
    T.StructField("violation_type", T.StringType()),
    T.StructField("offence_code", T.StringType()),
    T.StructField("created_datetime", T.StringType()),
    T.StructField("police_station", T.StringType()),
    T.StructField("junction_name", T.StringType()),
])

# Text columns whose "missing" spellings become NULL right after the scan.
TEXT_NULL_COLUMNS = ["id", "location", "vehicle_type", "violation_type",
                     "offence_code", "created_datetime", "police_station",
                     "junction_name"]

# --- fixed values: strings a CSV reader treats as missing (pandas defaults) --
NA_STRINGS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# --- fixed values: congestion severity weight of each parking tag (0-3) -----
PARKING_SEVERITY_WEIGHTS = {
    "DOUBLE PARKING": 3.0,
    "PARKING IN A MAIN ROAD": 3.0,
    "PARKING NEAR ROAD CROSSING": 2.5,
    "PARKING NEAR TRAFFIC LIGHT OR ZEBRA CROSS": 2.5,
    "PARKING OPPOSITE TO ANOTHER PARKED VEHICLE": 2.5,
    "WRONG PARKING": 2.0,
    "PARKING NEAR BUSTOP/SCHOOL/HOSPITAL ETC": 2.0,
    "NO PARKING": 1.5,
    "PARKING OTHER THAN BUS STOP": 1.5,
    "PARKING ON FOOTPATH": 1.0,
}

# --- fixed values: time, fill and junction rules ----------------------------
IST_OFFSET_MICROS = (5 * 3600 + 30 * 60) * 1_000_000   # UTC -> IST, +5:30
NO_JUNCTION = "No Junction"
UNKNOWN = "Unknown"

# --- fixed values: tiers and their map colours (RGBA) -----------------------
TIER_ORDER = ["Critical", "High", "Medium", "Low"]
TIER_COLORS = {
    "Critical": [214, 39, 40, 210],
    "High": [255, 127, 14, 185],
    "Medium": [255, 210, 87, 155],
    "Low": [44, 180, 44, 125],
}

# --- fixed values: map centre used when a view is empty, and grid origin ----
DEFAULT_CENTER = (12.9716, 77.5946)

# --- fixed values: mean hexagon cell area (km^2) by resolution --------------
HEX_AREA_KM2 = {
    0: 4357449.416, 1: 609788.442, 2: 86801.780, 3: 12393.435, 4: 1770.348, 5: 252.904,
    6: 36.129, 7: 5.161, 8: 0.737, 9: 0.105, 10: 0.015, 11: 0.002150643, 12: 0.000307092,
    13: 0.000043870, 14: 0.000006267, 15: 0.000000895,
}
KM_PER_DEG_LAT = 110.574
KM_PER_DEG_LON_EQUATOR = 111.32

# --- fixed values: composite score weights ----------------------------------
CIS_WEIGHTS = {"severity": 0.40, "junction": 0.20, "busy_hour": 0.20,
               "persistence": 0.20}
SCORE_COLUMNS = ["score_severity", "score_junction", "score_busy_hour",
                 "score_persistence"]

# --- fixed values: traffic-flow and delay-cost constants --------------------
FREE_FLOW_KMH = 40.0
OBSTRUCTION_SCALE = 3.0
JUNCTION_BOOST = 0.5
MAX_DENSITY_FRACTION = 0.85
QUEUE_KM_FACTOR = 2.5
DELAY_COST_PER_VEH_HR = 50.0
VEHICLES_PER_VIOLATION = 10
AVG_DELAY_MIN = 2.5
SEVERITY_DELAY_SCALE = 1.5
DAYS_PER_YEAR = 365

# --- fixed values: recommended action rules ---------------------------------
ACTION_JUNCTION = ("Coordinate with junction signal team "
                   "(high junction-approach blockage)")
ACTION_BUSY = "Schedule patrol during this hotspot's high-activity hours"
ACTION_CHRONIC = ("Chronic spot — consider physical deterrents / "
                  "no-parking signage")
ACTION_EMERGING = "Emerging trend — escalate before it becomes entrenched"
ACTION_DEFAULT = "Monitor; lower relative priority"
ACTION_JUNCTION_MIN = 0.5
ACTION_BUSY_MIN = 0.5
ACTION_CHRONIC_MIN = 0.5
ACTION_EMERGING_ABOVE = 0.05

# --- fixed values: patrol costs ---------------------------------------------
PATROL_COST_CRITICAL = 2
PATROL_COST_OTHER = 1

# --- fixed values: hourly density layer -------------------------------------
DENSITY_GREEN_DROP = 0.8
DENSITY_RADIUS_SCALE = 250
DENSITY_RADIUS_MIN = 40
DENSITY_RED = 255
DENSITY_BLUE = 0
DENSITY_ALPHA = 180
MAP_ELEVATION_SCALE = 30

# Features used for KMeans tiers, in order.
TIER_FEATURES = ["severity_weighted_count", "junction_fraction",
                 "busy_hour_fraction", "persistence_ratio", "growth_rate"]
