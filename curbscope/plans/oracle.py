"""Oracle SQL (DuckDB dialect) for the registered queries.

Each query is written independently of the Spark code path: straight from
the records with GROUP BY / window SQL, no cell rollup, no distributed rank
helper. Only shared fixed inputs (the events -> raw projection rules, the
hex-grid constants, the tag weights) are rendered from the same Python
values. Literals are cast to DOUBLE (DuckDB reads ``0.4`` as DECIMAL) and
half-even rounding uses ``round_even(x * 10^n, 0) / 10^n``.
"""

from __future__ import annotations

from curbscope import schema as S
from curbscope.functions.grid import hex_cell_sql
from curbscope.sources.events import repr_sql, violations_raw_sql


def d(v: float) -> str:
    return f"CAST('{float(v)!r}' AS DOUBLE)"


def q(s: str) -> str:
    return repr_sql(s)


def strip(x: str) -> str:
    from curbscope.functions.tags import WHITESPACE
    chars = " || ".join(f"chr({ord(c)})" for c in WHITESPACE)
    return f"trim({x}, {chars})"


def rint_round(x: str, digits: int) -> str:
    if digits == 0:
        return f"round_even({x}, 0)"
    scale = d(10.0 ** digits)
    return f"(round_even(({x}) * {scale}, 0) / {scale})"


def weight_case(t: str) -> str:
    arms = " ".join(f"WHEN {q(k)} THEN {d(v)}" for k, v in S.PARKING_SEVERITY_WEIGHTS.items())
    return f"CASE {t} {arms} ELSE NULL END"


def with_(ctes: list[tuple[str, str]], final: str) -> str:
    body = ",\n".join(f"{name} AS (\n{sql}\n)" for name, sql in ctes)
    return f"WITH {body}\n{final}"


# ---------------------------------------------------------------------------
# Shared record-level CTEs
# ---------------------------------------------------------------------------
def tags_sql(col: str = "violation_type") -> str:
    s = strip(col)
    return (f"CASE WHEN {col} IS NULL OR {s} = '' THEN CAST([] AS VARCHAR[]) "
            f"WHEN json_valid({s}) AND json_type(CAST({s} AS JSON)) = 'ARRAY' "
            f"THEN list_transform(from_json({s}, '[\"VARCHAR\"]'), lambda x: {strip('x')}) "
            f"ELSE [{s}] END")


def severity_sql(tags: str = "tags") -> str:
    return f"coalesce(list_max(list_transform({tags}, lambda t: {weight_case('t')})), {d(0.0)})"


def base_ctes(resolution: int = 9) -> list[tuple[str, str]]:
    ist = (f"make_timestamp(epoch_us(try_cast({strip('created_datetime')} AS TIMESTAMPTZ))"
           f" + {S.IST_OFFSET_MICROS})")
    return [
        ("raw", violations_raw_sql("events")),
        ("c1", f"SELECT *, {tags_sql()} AS tags FROM raw "
               "WHERE latitude IS NOT NULL AND longitude IS NOT NULL "
               "AND created_datetime IS NOT NULL"),
        ("c2", f"SELECT *, {severity_sql()} AS severity FROM c1"),
        ("c3", f"SELECT *, {ist} AS created_ist FROM c2 WHERE severity > 0"),
        ("clean", f"""SELECT id, latitude, longitude, location,
  coalesce(vehicle_type, {q(S.UNKNOWN)}) AS vehicle_type, violation_type, offence_code,
  created_datetime, coalesce(police_station, {q(S.UNKNOWN)}) AS police_station,
  coalesce(junction_name, {q(S.NO_JUNCTION)}) AS junction_name,
  tags, severity, created_ist,
  CAST(hour(created_ist) AS INTEGER) AS hour,
  CAST(isodow(created_ist) - 1 AS INTEGER) AS weekday,
  CAST(created_ist AS DATE) AS date,
  lower({strip(f"coalesce(junction_name, {q(S.NO_JUNCTION)})")}) <> 'no junction' AS at_junction
FROM c3 WHERE created_ist IS NOT NULL"""),
        ("hexed", f"SELECT *, {hex_cell_sql('latitude', 'longitude', resolution)} AS hex_id FROM clean"),
    ]


def busy_ctes(coverage: float = 0.5) -> list[tuple[str, str]]:
    return [
        ("hour_counts", "SELECT hour, CAST(count(*) AS BIGINT) AS n FROM hexed GROUP BY hour"),
        ("hour_cum", """SELECT hour, n,
  sum(n) OVER (ORDER BY n DESC, hour ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
  sum(n) OVER () AS total FROM hour_counts"""),
        ("busy", f"""SELECT hour, n, CAST(cum AS DOUBLE) / CAST(total AS DOUBLE) AS cum_share
FROM hour_cum WHERE CAST(cum - n AS DOUBLE) / CAST(total AS DOUBLE) < {d(coverage)}"""),
    ]


def span_ctes() -> list[tuple[str, str]]:
    return [("span", """SELECT CAST(greatest(date_diff('day', min(date), max(date)), 1) AS INTEGER) AS n_days,
  min(date) AS first_date, max(date) AS last_date FROM hexed""")]


def e7(x: str) -> str:
    return f"CAST(floor({x} * {d(1e7)} + {d(0.5)}) AS BIGINT)"


def feature_ctes(coverage: float = 0.5) -> list[tuple[str, str]]:
    mode = """SELECT hex_id, {col} AS v FROM (
  SELECT hex_id, {col}, row_number() OVER (PARTITION BY hex_id ORDER BY count(*) DESC, {col}) AS rn
  FROM hexed GROUP BY hex_id, {col}) WHERE rn = 1"""
    return busy_ctes(coverage) + span_ctes() + [
        ("station_mode", mode.format(col="police_station")),
        ("vehicle_mode", mode.format(col="vehicle_type")),
        ("feat0", """SELECT h.hex_id,
  CAST(count(*) AS BIGINT) AS violation_count,
  sum(h.severity) AS severity_weighted_count,
  sum(CAST(h.at_junction AS BIGINT)) AS jct_n,
  sum(CASE WHEN b.hour IS NOT NULL THEN 1 ELSE 0 END) AS busy_n,
  CAST(count(DISTINCT h.date) AS BIGINT) AS active_days,
  sum(""" + e7("h.latitude") + """) AS lat_e7,
  sum(""" + e7("h.longitude") + """) AS lon_e7
FROM hexed h LEFT JOIN busy b ON h.hour = b.hour GROUP BY h.hex_id"""),
        ("features", f"""SELECT f.hex_id, f.violation_count, f.severity_weighted_count,
  f.severity_weighted_count / CAST(f.violation_count AS DOUBLE) AS avg_severity,
  CAST(f.jct_n AS DOUBLE) / CAST(f.violation_count AS DOUBLE) AS junction_fraction,
  CAST(f.busy_n AS DOUBLE) / CAST(f.violation_count AS DOUBLE) AS busy_hour_fraction,
  f.active_days,
  (CAST(f.lat_e7 AS DOUBLE) / CAST(f.violation_count AS DOUBLE)) / {d(1e7)} AS latitude,
  (CAST(f.lon_e7 AS DOUBLE) / CAST(f.violation_count AS DOUBLE)) / {d(1e7)} AS longitude,
  sm.v AS dominant_station, vm.v AS dominant_vehicle,
  least(CAST(f.active_days AS DOUBLE) / CAST((SELECT n_days FROM span) AS DOUBLE), {d(1.0)})
    AS persistence_ratio
FROM feat0 f JOIN station_mode sm USING (hex_id) JOIN vehicle_mode vm USING (hex_id)"""),
    ]


def weekly_ctes() -> list[tuple[str, str]]:
    return [
        ("weekly", """SELECT hex_id, CAST(date_trunc('week', date) AS DATE) AS week,
  CAST(count(*) AS BIGINT) AS count FROM hexed GROUP BY hex_id, CAST(date_trunc('week', date) AS DATE)"""),
        ("wx", "SELECT *, row_number() OVER (PARTITION BY hex_id ORDER BY week) - 1 AS x FROM weekly"),
        ("ols", """SELECT hex_id, count(*) AS n, sum(x) AS sx, sum(x * x) AS sxx,
  sum(x * count) AS sxy, sum(count) AS sy, max(week) AS last_week FROM wx GROUP BY hex_id"""),
        ("ols2", f"""SELECT *,
  CASE WHEN (n * sxx - sx * sx) = 0 THEN {d(0.0)}
       ELSE CAST(n * sxy - sx * sy AS DOUBLE) / CAST(n * sxx - sx * sx AS DOUBLE) END AS b1
FROM ols"""),
        ("trend", f"""SELECT hex_id,
  CASE WHEN n < 3 OR sy = 0 THEN {d(0.0)}
       ELSE b1 / (CAST(sy AS DOUBLE) / CAST(n AS DOUBLE)) END AS growth_rate FROM ols2"""),
    ]


def forecast_ctes(weeks_ahead: int = 2, label: str = "week_start") -> list[tuple[str, str]]:
    shift = 6 if label == "reference" else 0
    return [("forecast", f"""SELECT hex_id, CAST(step AS INTEGER) AS step,
  CAST(last_week + CAST(7 * step + {shift} AS INTEGER) AS DATE) AS week,
  CASE WHEN n < 3 THEN greatest(CAST(sy AS DOUBLE) / CAST(n AS DOUBLE), {d(0.0)})
       ELSE greatest(b1 * CAST(n - 1 + step AS DOUBLE)
                     + (CAST(sy AS DOUBLE) - b1 * CAST(sx AS DOUBLE)) / CAST(n AS DOUBLE), {d(0.0)})
  END AS forecast_count
FROM ols2, (SELECT unnest(generate_series(1, {int(weeks_ahead)})) AS step) s""")]


def pct_rank(col: str) -> str:
    return (f"CAST(2 * (rank() OVER (ORDER BY {col}) - 1) + count(*) OVER (PARTITION BY {col}) + 1"
            f" AS DOUBLE) / CAST(2 * count(*) OVER () AS DOUBLE)")


def cis_expr(ws: float, wj: float, wb: float, wp: float) -> str:
    return (f"(((({d(ws)} * score_severity + {d(wj)} * score_junction) + {d(wb)} * score_busy_hour)"
            f" + {d(wp)} * score_persistence) * {d(100.0)})")


def tier_case(col: str = "congestion_impact_score") -> tuple[str, str]:
    tier = (f"CASE WHEN {col} >= 75 THEN 'Critical' WHEN {col} >= 50 THEN 'High' "
            f"WHEN {col} >= 25 THEN 'Medium' ELSE 'Low' END")
    idx = (f"CAST(CASE WHEN {col} >= 75 THEN 0 WHEN {col} >= 50 THEN 1 "
           f"WHEN {col} >= 25 THEN 2 ELSE 3 END AS INTEGER)")
    return tier, idx


def hot_ctes() -> list[tuple[str, str]]:
    w = S.CIS_WEIGHTS
    tier, idx = tier_case()
    k = (f"least(least(avg_severity / {d(3.0)}, {d(1.0)}) * ({d(1.0)} + junction_fraction * {d(0.5)}),"
         f" {d(0.85)})")
    return feature_ctes() + weekly_ctes() + [
        ("cells", f"""SELECT f.*, coalesce(t.growth_rate, {d(0.0)}) AS growth_rate
FROM features f LEFT JOIN trend t USING (hex_id)"""),
        ("scored0", f"""SELECT *,
  {pct_rank('severity_weighted_count')} AS score_severity,
  {pct_rank('junction_fraction')} AS score_junction,
  {pct_rank('busy_hour_fraction')} AS score_busy_hour,
  {pct_rank('persistence_ratio')} AS score_persistence FROM cells"""),
        ("scored", f"SELECT *, {cis_expr(w['severity'], w['junction'], w['busy_hour'], w['persistence'])}"
                   " AS congestion_impact_score FROM scored0"),
        ("tiered", f"SELECT *, {idx} AS cluster, {tier} AS tier, {k} AS k_frac FROM scored"),
        ("flow", f"""SELECT *,
  {rint_round('k_frac * ' + d(100.0), 1)} AS capacity_loss_pct,
  {rint_round(d(40.0) + ' * (' + d(1.0) + ' - k_frac)', 1)} AS effective_speed_kmh FROM tiered"""),
        ("hot", f"""SELECT * EXCLUDE (k_frac, dv),
  CAST({rint_round('dv * ' + d(10.0) + ' * ' + d(2.5 / 60) + ' * (avg_severity / ' + d(1.5) + ') * '
                   + d(50.0), 0)} AS BIGINT) AS daily_delay_cost_inr,
  CAST({rint_round('dv * ' + d(10.0) + ' * ' + d(2.5 / 60) + ' * (avg_severity / ' + d(1.5) + ') * '
                   + d(50.0), 0)} AS BIGINT) * 365 AS annual_delay_cost_inr
FROM (SELECT *,
  {rint_round('capacity_loss_pct / ' + d(100.0) + ' * ' + d(2.5) + ' * persistence_ratio', 2)}
    AS shockwave_queue_km,
  greatest(CAST(violation_count AS DOUBLE) / CAST(greatest((SELECT n_days FROM span), 1) AS DOUBLE),
           {d(0.0)}) AS dv
  FROM flow)"""),
    ]


def action_sql() -> str:
    return f"""CASE WHEN concat_ws('; ',
    CASE WHEN junction_fraction >= {d(0.5)} THEN {q(S.ACTION_JUNCTION)} END,
    CASE WHEN busy_hour_fraction >= {d(0.5)} THEN {q(S.ACTION_BUSY)} END,
    CASE WHEN persistence_ratio >= {d(0.5)} THEN {q(S.ACTION_CHRONIC)} END,
    CASE WHEN growth_rate > {d(0.05)} THEN {q(S.ACTION_EMERGING)} END) = ''
  THEN {q(S.ACTION_DEFAULT)}
  ELSE concat_ws('; ',
    CASE WHEN junction_fraction >= {d(0.5)} THEN {q(S.ACTION_JUNCTION)} END,
    CASE WHEN busy_hour_fraction >= {d(0.5)} THEN {q(S.ACTION_BUSY)} END,
    CASE WHEN persistence_ratio >= {d(0.5)} THEN {q(S.ACTION_CHRONIC)} END,
    CASE WHEN growth_rate > {d(0.05)} THEN {q(S.ACTION_EMERGING)} END) END"""
