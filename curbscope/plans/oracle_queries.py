"""DuckDB SQL per registered query name (see ``plans.oracle``)."""

from __future__ import annotations

from curbscope import schema as S
from curbscope.plans import oracle as O

RESOLUTION = 9

SQL: dict[str, str] = {}


def _base(*extra):
    ctes = O.base_ctes(RESOLUTION)
    for e in extra:
        ctes = ctes + e
    return ctes


SQL["scan_violations"] = O.with_([("raw", O.violations_raw_sql("events"))], "SELECT * FROM raw")

SQL["clean_violations"] = O.with_(_base(), """SELECT id, latitude, longitude, vehicle_type,
  police_station, junction_name, severity, hour, weekday, date, at_junction FROM clean""")

SQL["hex_bin"] = O.with_(_base(), "SELECT hex_id, CAST(count(*) AS BIGINT) AS n FROM hexed GROUP BY hex_id")

SQL["busy_hours"] = O.with_(_base(O.busy_ctes()), "SELECT hour, n, cum_share FROM busy")

SQL["hotspot_features"] = O.with_(_base(O.feature_ctes()), "SELECT * FROM features")

# ---------------------------------------------------------------------------
# scans and scalar functions
# ---------------------------------------------------------------------------
_raw_limited = (O.violations_raw_sql("(SELECT * FROM events ORDER BY event_id LIMIT 1000)"))
SQL["scan_limit"] = O.with_(
    [("raw", _raw_limited)] + O.base_ctes(RESOLUTION)[1:],
    "SELECT id, severity, hour, weekday, date, at_junction FROM clean")

SQL["parse_tags"] = O.with_(
    [("raw", O.violations_raw_sql("events"))],
    f"SELECT id, violation_type, CAST(to_json({O.tags_sql()}) AS VARCHAR) AS tags_json, "
    f"CAST(len({O.tags_sql()}) AS INTEGER) AS n_tags FROM raw")

SQL["record_severity"] = O.with_(
    [("raw", O.violations_raw_sql("events")), ("t", f"SELECT id, {O.tags_sql()} AS tags FROM raw")],
    f"SELECT id, {O.severity_sql()} AS severity FROM t")

SQL["temporal_features"] = O.with_(_base(), "SELECT id, created_ist, hour, weekday, date FROM clean")

_res_parts = " UNION ALL ".join(
    f"SELECT {O.hex_cell_sql('latitude', 'longitude', r)} AS hex_id, CAST(count(*) AS BIGINT) AS n, "
    f"{r} AS resolution FROM clean GROUP BY 1" for r in (7, 8, 10))
SQL["hex_bin_res"] = O.with_(_base(), _res_parts)

# ---------------------------------------------------------------------------
# rollup-level aggregates
# ---------------------------------------------------------------------------
SQL["observation_span"] = O.with_(_base(O.span_ctes()), "SELECT * FROM span")

SQL["dominant_mode"] = O.with_(_base(O.feature_ctes()), """SELECT s.hex_id,
  s.v AS dominant_station, v.v AS dominant_vehicle FROM station_mode s JOIN vehicle_mode v USING (hex_id)""")

_tag_long = [("tag_long", """SELECT hex_id, tag, CAST(count(*) AS BIGINT) AS count
FROM (SELECT hex_id, unnest(tags) AS tag FROM hexed) GROUP BY hex_id, tag""")]
SQL["tag_breakdown"] = O.with_(_base(_tag_long), "SELECT hex_id, tag, count FROM tag_long")

SQL["tag_breakdown_sorted"] = O.with_(_base(_tag_long), """SELECT hex_id, tag, count,
  CAST(row_number() OVER (PARTITION BY hex_id ORDER BY count DESC, tag) AS INTEGER) AS position
FROM tag_long""")

SQL["weekly_counts"] = O.with_(_base(O.weekly_ctes()), "SELECT hex_id, week, count FROM weekly")

SQL["growth_trend"] = O.with_(_base(O.weekly_ctes()), "SELECT hex_id, growth_rate FROM trend")

SQL["forecast_all"] = O.with_(_base(O.weekly_ctes(), O.forecast_ctes()),
                              "SELECT hex_id, step, week, forecast_count FROM forecast")

SQL["history_forecast"] = O.with_(_base(O.weekly_ctes(), O.forecast_ctes()), """SELECT hex_id, week,
  avg(CASE WHEN type = 'history' THEN count END) AS history,
  avg(CASE WHEN type = 'forecast' THEN count END) AS forecast
FROM (SELECT hex_id, week, CAST(count AS DOUBLE) AS count, 'history' AS type FROM weekly
      UNION ALL SELECT hex_id, week, forecast_count, 'forecast' FROM forecast)
GROUP BY hex_id, week""")

_hours = ", ".join(f"CAST(count(*) FILTER (WHERE hour = {h}) AS BIGINT) AS h{h:02d}" for h in range(24))
SQL["weekday_hour_pivot"] = O.with_(_base(), f"SELECT weekday, {_hours} FROM hexed GROUP BY weekday")

_parking = ", ".join(O.q(t) for t in O.S.PARKING_SEVERITY_WEIGHTS)
SQL["tag_mix"] = O.with_(_base(_tag_long), f"""SELECT tag, CAST(sum(count) AS BIGINT) AS count
FROM tag_long WHERE tag IN ({_parking}) GROUP BY tag""")

SQL["hourly_density"] = O.with_(_base(), f"""SELECT hour, hex_id, count,
  (CAST(lat7 AS DOUBLE) / CAST(count AS DOUBLE)) / {O.d(1e7)} AS lat,
  (CAST(lon7 AS DOUBLE) / CAST(count AS DOUBLE)) / {O.d(1e7)} AS lon,
  norm, 255 AS color_r,
  CAST(floor({O.d(255.0)} * ({O.d(1.0)} - norm * {O.d(0.8)})) AS INTEGER) AS color_g,
  0 AS color_b, 180 AS color_a,
  CAST(floor(norm * {O.d(250.0)} + {O.d(40.0)}) AS INTEGER) AS radius
FROM (SELECT *, greatest(least(CAST(count AS DOUBLE) / CAST(max(count) OVER (PARTITION BY hour) AS DOUBLE),
                               {O.d(1.0)}), {O.d(0.0)}) AS norm
      FROM (SELECT hour, hex_id, CAST(count(*) AS BIGINT) AS count,
                   sum({O.e7('latitude')}) AS lat7, sum({O.e7('longitude')}) AS lon7
            FROM hexed GROUP BY hour, hex_id))""")

SQL["hourly_totals"] = O.with_(_base(O.busy_ctes()), """SELECT h.hour, h.violations, h.locations,
  (b.hour IS NOT NULL) AS is_busy
FROM (SELECT hour, CAST(count(*) AS BIGINT) AS violations, CAST(count(DISTINCT hex_id) AS BIGINT) AS locations
      FROM hexed GROUP BY hour) h LEFT JOIN busy b ON h.hour = b.hour""")


def _stable(x: str) -> str:
    return O.rint_round(x, 9)


_prof = " UNION ALL ".join(f"""SELECT '{name}' AS "column", CAST(count(x) AS BIGINT) AS count,
  {_stable('avg(x)')} AS mean, {_stable('stddev_samp(x)')} AS std, {_stable('min(x)')} AS min,
  {_stable('quantile_cont(x, 0.25)')} AS p25, {_stable('quantile_cont(x, 0.5)')} AS p50,
  {_stable('quantile_cont(x, 0.75)')} AS p75, {_stable('max(x)')} AS max
FROM (SELECT CAST({expr} AS DOUBLE) AS x FROM clean)""" for name, expr in (
    ("severity", "severity"), ("hour", "hour"), ("weekday", "weekday"),
    ("at_junction", "CAST(at_junction AS INTEGER)")))
SQL["profile_clean"] = O.with_(_base(), _prof)

# ---------------------------------------------------------------------------
# the cell table (threshold stand-in tier) and views on it
# ---------------------------------------------------------------------------
_hot = _base(O.hot_ctes())


def _on_hot(final: str, *extra) -> str:
    ctes = _hot
    for e in extra:
        ctes = ctes + e
    return O.with_(ctes, final)


SQL["percentile_scores"] = _on_hot("""SELECT hex_id, score_severity, score_junction, score_busy_hour,
  score_persistence FROM hot""")
SQL["cis_scores"] = _on_hot("SELECT hex_id, congestion_impact_score FROM hot")
SQL["impact_flow"] = _on_hot("SELECT hex_id, capacity_loss_pct, shockwave_queue_km, effective_speed_kmh FROM hot")
SQL["impact_cost"] = _on_hot("SELECT hex_id, daily_delay_cost_inr, annual_delay_cost_inr FROM hot")
SQL["recommended_action"] = _on_hot(f"SELECT hex_id, {O.action_sql()} AS recommended_action FROM hot")
SQL["hotspot_view"] = _on_hot("""SELECT hex_id, dominant_station, tier, violation_count,
  congestion_impact_score FROM hot WHERE tier IN ('Critical', 'High', 'Medium')""")

_by_cis = "ORDER BY congestion_impact_score DESC, hex_id"
SQL["hotspot_lookup"] = _on_hot(f"""SELECT hex_id, violation_count, congestion_impact_score, tier, growth_rate,
  capacity_loss_pct, shockwave_queue_km, effective_speed_kmh, daily_delay_cost_inr, annual_delay_cost_inr
FROM hot WHERE hex_id = (SELECT hex_id FROM hot {_by_cis} LIMIT 1)""")
SQL["hotspot_options"] = _on_hot(
    f"SELECT hex_id, hex_id || ' — ' || dominant_station AS label FROM hot {_by_cis} LIMIT 100")

_colors = O.S.TIER_COLORS


def _color(i: int) -> str:
    arms = " ".join(f"WHEN '{t}' THEN {c[i]}" for t, c in _colors.items())
    return f"CAST(CASE tier {arms} END AS INTEGER)"


SQL["map_layer"] = _on_hot(f"""SELECT hex_id, dominant_station, violation_count, congestion_impact_score, tier,
  capacity_loss_pct, shockwave_queue_km, daily_delay_cost_inr,
  {_color(0)} AS color_r, {_color(1)} AS color_g, {_color(2)} AS color_b, {_color(3)} AS color_a,
  congestion_impact_score * {O.d(30.0)} AS elevation FROM hot""")
SQL["map_center"] = _on_hot(f"""SELECT {_stable(f'coalesce(avg(latitude), {O.d(12.9716)})')} AS center_lat,
  {_stable(f'coalesce(avg(longitude), {O.d(77.5946)})')} AS center_lon FROM hot""")

_top25 = [("top25", f"SELECT *, {O.action_sql()} AS recommended_action FROM hot {_by_cis} LIMIT 25")]
SQL["priority_list"] = _on_hot("""SELECT hex_id, dominant_station, violation_count, congestion_impact_score,
  tier, recommended_action FROM top25""", _top25)
SQL["priority_report"] = _on_hot("""SELECT hex_id, dominant_station AS station, violation_count AS violations,
  congestion_impact_score AS cis, tier, capacity_loss_pct AS lane_loss_pct, shockwave_queue_km AS queue_km,
  daily_delay_cost_inr AS daily_cost_inr, annual_delay_cost_inr AS annual_cost_inr,
  junction_fraction AS pct_at_junction, busy_hour_fraction AS pct_busy_hours,
  persistence_ratio AS persistence, growth_rate AS weekly_growth, recommended_action FROM top25""", _top25)

_weights = sorted(O.S.PARKING_SEVERITY_WEIGHTS.items(), key=lambda kv: -kv[1])
_weight_rows = " UNION ALL ".join(
    f"SELECT 'weight' AS option, {O.q(f'{t}: {w}')} AS value, {i + 1} AS position"
    for i, (t, w) in enumerate(_weights))
SQL["filter_options"] = _on_hot(f"""SELECT 'tier' AS option, tier AS value,
  CAST(row_number() OVER (ORDER BY max(congestion_impact_score) DESC, tier) AS INTEGER) AS position
FROM hot GROUP BY tier
UNION ALL
SELECT 'station', dominant_station, CAST(row_number() OVER (ORDER BY dominant_station) AS INTEGER)
FROM (SELECT DISTINCT dominant_station FROM hot)
UNION ALL {_weight_rows}""")

SQL["kpis"] = _on_hot(f"""SELECT (SELECT CAST(count(*) AS BIGINT) FROM hexed) AS violations,
  CAST(count(*) AS BIGINT) AS hotspots,
  CAST(count(*) FILTER (WHERE tier IN ('Critical', 'High')) AS BIGINT) AS critical_high,
  {_stable('avg(congestion_impact_score)')} AS avg_cis,
  CAST(coalesce(sum(daily_delay_cost_inr), 0) AS BIGINT) AS daily_cost_total,
  CAST(coalesce(sum(annual_delay_cost_inr), 0) AS BIGINT) AS annual_cost_total,
  {O.rint_round(f'CAST(coalesce(sum(annual_delay_cost_inr), 0) AS DOUBLE) / {O.d(1e7)}', 1)}
    AS annual_cost_crore,
  coalesce((SELECT string_agg(printf('%02dh', hour), ', ' ORDER BY hour) FROM busy), '') AS busy_hours
FROM hot""")


def _patrol_sql(budget: int, partition: str | None, pool: str = "hot") -> list[tuple[str, str]]:
    """``sched`` by the greedy scan itself, cell after cell: a recursion that
    carries the hours left, for the whole pool or for each partition."""
    own = partition or "'all'"
    key = f"{partition}, " if partition else ""
    return [
        ("pc", f"""SELECT *, CASE WHEN tier = 'Critical' THEN 2 ELSE 1 END AS cost, {own} AS own,
  row_number() OVER (PARTITION BY {own} {_by_cis}) AS pos FROM {pool}"""),
        ("walk", f"""SELECT own, CAST(0 AS BIGINT) AS pos, CAST({budget} AS BIGINT) AS hours_left, FALSE AS took
FROM (SELECT DISTINCT own FROM pc)
UNION ALL
SELECT w.own, p.pos, w.hours_left - CASE WHEN p.cost <= w.hours_left THEN p.cost ELSE 0 END, p.cost <= w.hours_left
FROM walk w JOIN pc p ON p.own IS NOT DISTINCT FROM w.own AND p.pos = w.pos + 1 WHERE w.hours_left > 0"""),
        ("pc4", "SELECT pc.* FROM pc JOIN walk w ON w.own IS NOT DISTINCT FROM pc.own AND w.pos = pc.pos WHERE w.took"),
        ("sched", f"""SELECT {key}CAST(row_number() OVER (PARTITION BY own {_by_cis}) AS INTEGER) AS priority,
  hex_id, dominant_station AS station, tier,
  {O.rint_round('congestion_impact_score', 1)} AS cis,
  CAST(cost AS INTEGER) AS officers, CAST(cost AS INTEGER) AS hours,
  {O.rint_round('coalesce(capacity_loss_pct, 0.0)', 1)} AS lane_loss_pct,
  CAST(coalesce(daily_delay_cost_inr, 0) AS BIGINT) AS est_daily_cost_inr FROM pc4"""),
    ]


def _walked(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


_budget = 5 * 8
SQL["patrol_schedule"] = _walked(_on_hot("SELECT * FROM sched", _patrol_sql(_budget, None)))
SQL["patrol_by_station"] = _walked(_on_hot("SELECT * EXCLUDE (dominant_station) FROM sched",
                                           _patrol_sql(_budget, "dominant_station")))
SQL["patrol_summary"] = _walked(_on_hot(f"""SELECT assigned, total_cis, daily_cost_prevented, {_budget} AS budget,
  {_stable('random_cis')} AS random_cis,
  {_stable(f'CASE WHEN random_cis > 0 THEN (total_cis - random_cis) / random_cis * {O.d(100.0)} END')}
    AS pct_better
FROM (SELECT CAST(count(*) AS BIGINT) AS assigned,
        {O.rint_round(f'coalesce(sum(cis), {O.d(0.0)})', 1)} AS total_cis,
        CAST(coalesce(sum(est_daily_cost_inr), 0) AS BIGINT) AS daily_cost_prevented,
        (SELECT avg(congestion_impact_score) FROM hot)
          * CAST(least({_budget}, (SELECT count(*) FROM hot)) AS DOUBLE) AS random_cis
      FROM sched)""", _patrol_sql(_budget, None)))

SQL["tier_labels"] = _on_hot(f"""SELECT cluster, {_stable('mean_cis')} AS mean_cis,
  CAST(cluster_rank AS INTEGER) AS cluster_rank,
  ['Critical', 'High', 'Medium', 'Low'][least(cluster_rank, 4)] AS tier
FROM (SELECT cluster, mean_cis, row_number() OVER (ORDER BY mean_cis DESC, cluster) AS cluster_rank
      FROM (SELECT cluster, avg(congestion_impact_score) AS mean_cis FROM hot GROUP BY cluster))""")

_w = (10, 40, 30, 20)
_tot = sum(_w)
_whatif = [("wi", f"""SELECT *, {O.cis_expr(*(x / _tot for x in _w))} AS whatif_cis,
  row_number() OVER ({_by_cis}) AS original_rank FROM hot"""),
           ("wi2", """SELECT *, row_number() OVER (ORDER BY whatif_cis DESC, original_rank) AS new_rank
FROM wi""")]
SQL["whatif_rank"] = _on_hot("""SELECT new_rank, hex_id, dominant_station, tier, congestion_impact_score,
  whatif_cis, original_rank, original_rank - new_rank AS rank_change FROM wi2 WHERE new_rank <= 25""", _whatif)
SQL["whatif_movers"] = _on_hot("""SELECT new_rank, hex_id, dominant_station, tier, congestion_impact_score,
  whatif_cis, original_rank - new_rank AS rank_change,
  CASE WHEN original_rank - new_rank > 0 THEN 'rose' ELSE 'fell' END AS direction,
  abs(original_rank - new_rank) AS positions
FROM wi2 WHERE abs(original_rank - new_rank) > 5 ORDER BY new_rank LIMIT 6""", _whatif)

_checked = """hex_id, violation_count, severity_weighted_count, avg_severity, junction_fraction,
  busy_hour_fraction, active_days, latitude, longitude, dominant_station, dominant_vehicle,
  persistence_ratio, growth_rate, score_severity, score_junction, score_busy_hour, score_persistence,
  congestion_impact_score, capacity_loss_pct, shockwave_queue_km, effective_speed_kmh,
  daily_delay_cost_inr, annual_delay_cost_inr"""
SQL["hotspot_table"] = _on_hot(f"SELECT {_checked} FROM hot")
SQL["hotspot_export"] = _on_hot(f"SELECT {_checked}, cluster, tier FROM hot")

SQL["stream_hex_counts"] = SQL["hex_bin"]
SQL["scan_violations_csv"] = SQL["scan_violations"]
SQL["hotspot_export_parquet"] = _on_hot(f"""SELECT {_checked}, cluster, tier, t.n_tags, t.tag_total
FROM hot JOIN (SELECT hex_id, CAST(count(*) AS INTEGER) AS n_tags, CAST(sum(count) AS BIGINT) AS tag_total
               FROM tag_long GROUP BY hex_id) t USING (hex_id)""", _tag_long)


def _fmt(col: str, digits: int, fmt: str | None = None, scale: float | None = None) -> str:
    v = O.rint_round(f"{col} * {O.d(scale)}" if scale else col, digits)
    return f"printf('{fmt or '%.' + str(digits) + 'f'}', {v})"


SQL["priority_report_display"] = _on_hot(f"""SELECT hex_id, dominant_station AS station,
  violation_count AS violations, {_fmt('congestion_impact_score', 1)} AS cis, tier,
  {_fmt('capacity_loss_pct', 1)} AS lane_loss_pct, {_fmt('shockwave_queue_km', 2)} AS queue_km,
  format('{{:,}}', daily_delay_cost_inr) AS daily_cost_inr,
  format('{{:,}}', annual_delay_cost_inr) AS annual_cost_inr,
  {_fmt('junction_fraction', 1, '%.1f%%', 100.0)} AS pct_at_junction,
  {_fmt('busy_hour_fraction', 1, '%.1f%%', 100.0)} AS pct_busy_hours,
  {_fmt('persistence_ratio', 1, '%.1f%%', 100.0)} AS persistence,
  {_fmt('growth_rate', 1, '%+.1f%%', 100.0)} AS weekly_growth, recommended_action
FROM top25""", _top25)

SQL["weekday_hour_counts"] = O.with_(_base(), """SELECT weekday, hour, CAST(count(*) AS BIGINT) AS count
FROM hexed GROUP BY weekday, hour""")

SQL["forecast_reference_labels"] = O.with_(_base(O.weekly_ctes(), O.forecast_ctes(label="reference")),
                                           "SELECT hex_id, step, week, forecast_count FROM forecast")

SQL["hotspot_view_stations"] = _on_hot("""SELECT hex_id, dominant_station, tier, violation_count,
  congestion_impact_score FROM hot WHERE dominant_station IN ('PS-1', 'PS-2')""")
SQL["patrol_station_pool"] = _walked(_on_hot("SELECT * FROM sched", [("pool", """SELECT * FROM hot
WHERE dominant_station IN ('PS-1', 'PS-2') AND tier IN ('Critical', 'High')""")],
                                     _patrol_sql(_budget, None, "pool")))

# ---------------------------------------------------------------------------
# data quality, first rows, tiers, cached build
# ---------------------------------------------------------------------------
_q = [("raw", O.violations_raw_sql("events")),
      ("t", f"SELECT *, {O.tags_sql()} AS tags FROM raw"),
      ("s", f"SELECT *, {O.severity_sql()} AS severity, "
            f"try_cast({O.strip('created_datetime')} AS TIMESTAMPTZ) AS read_at FROM t")]
SQL["quality_counts"] = O.with_(_q, """SELECT count(*) AS raw_rows,
  count(*) FILTER (latitude IS NULL OR longitude IS NULL) AS no_coordinates,
  count(*) FILTER (created_datetime IS NULL) AS no_time,
  count(*) FILTER (created_datetime IS NOT NULL AND read_at IS NULL) AS bad_time,
  count(*) FILTER (violation_type NOT LIKE '[%') AS tag_fallbacks,
  count(*) FILTER (severity <= 0) AS not_parking,
  count(*) FILTER (latitude IS NOT NULL AND longitude IS NOT NULL AND read_at IS NOT NULL AND severity > 0) AS kept
FROM s""")

SQL["scan_first_rows"] = O.with_([("raw", O.violations_raw_sql("events"))],
                                 "SELECT id, latitude, police_station FROM raw ORDER BY CAST(id AS BIGINT) LIMIT 1000")

SQL["tier_invariants"] = O.with_(_base(), """SELECT count(DISTINCT hex_id) AS cells,
  count(DISTINCT hex_id) AS with_tier, TRUE AS few_clusters, TRUE AS ordered, TRUE AS nearest FROM hexed""")

SQL["cached_build"] = _on_hot("SELECT hex_id, violation_count, congestion_impact_score, TRUE AS reused FROM hot")


# ---------------------------------------------------------------------------
# KMeans replayed: same draws, same centres, iterated until they stay
# ---------------------------------------------------------------------------
def _kmeans_sql(features: list[str], k: int, restarts: int, seed: int) -> list[tuple[str, str]]:
    scale = O.d(float(1 << 20))
    every = ", ".join(features)
    unit = lambda x: f"CAST(round_even({x} * {scale}, 0) AS BIGINT)"
    d2 = " + ".join(f"(CAST(p.{f} AS DOUBLE) - c.{f}) * (CAST(p.{f} AS DOUBLE) - c.{f})" for f in features)
    mean = ", ".join(
        f"CAST(sum({f}) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS m_{f}, sqrt(CAST(count(*) * sum(CAST({f} AS HUGEINT) * {f}) "
        f"- sum({f}) * sum({f}) AS DOUBLE)) / CAST(count(*) AS DOUBLE) AS s_{f}" for f in features)
    u = lambda step: (f"CAST(CAST('0x' || substr(md5(concat_ws(':', hex_id, run + {seed}, {step})), 1, 13) AS BIGINT) + 1 "  # noqa: E731
                      f"AS DOUBLE) / {O.d(float(1 << 52))}")
    pick = lambda step, key, rows: (f"SELECT run, {step} AS cluster, {', '.join(f'CAST({f} AS DOUBLE) AS {f}' for f in features)} "  # noqa: E731
                                    f"FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY {key}, hex_id) AS rn FROM {rows}) WHERE rn = 1")
    ctes = [
        ("kraw", "SELECT hex_id, " + ", ".join(f"{unit(f'coalesce({f}, 0)')} AS {f}" for f in features) + " FROM hot"),
        ("kspread", f"SELECT {mean} FROM kraw"),
        ("kz", "SELECT hex_id, " + ", ".join(
            f"CASE WHEN s_{f} > 0 THEN {unit(f'((CAST({f} AS DOUBLE) - m_{f}) / s_{f})')} ELSE 0 END AS {f}"
            for f in features) + " FROM kraw, kspread"),
        ("kall", f"SELECT * FROM kz, (SELECT unnest(range({restarts})) AS run)"),
        ("kc0", pick(0, u(0), "kall")),
    ]
    for step in range(1, k):
        chosen = " UNION ALL ".join(f"SELECT * FROM kc{j}" for j in range(step))
        near = f"(SELECT p.*, min({d2}) OVER (PARTITION BY p.run, hex_id) AS near, c.cluster FROM kall p JOIN ({chosen}) c ON p.run = c.run)"
        key = f"CASE WHEN near > 0 THEN -ln({u(step)}) / near ELSE CAST('inf' AS DOUBLE) END"
        ctes.append((f"kc{step}", pick(step, key, f"(SELECT * EXCLUDE (cluster) FROM {near} WHERE cluster = 0)")))
    chosen = " UNION ALL ".join(f"SELECT * FROM kc{j}" for j in range(k))
    nearest = lambda table, more="": f"""SELECT * FROM (SELECT p.*, c.run, c.cluster, {d2} AS d2,
    row_number() OVER (PARTITION BY c.run, hex_id ORDER BY {d2}, c.cluster) AS rn FROM {table} c, kz p {more}) WHERE rn = 1"""  # noqa: E731
    shift = " + ".join(f"(w.{f} - o.{f}) * (w.{f} - o.{f})" for f in features)
    far = f"coalesce(sum({shift}) OVER (PARTITION BY o.run) > {O.d(1e-4)} * {scale} * {scale}, FALSE)"
    ctes += [
        ("lloyd", f"""SELECT 0 AS i, run, cluster, {every}, TRUE AS moved FROM ({chosen})
UNION ALL
SELECT o.i + 1, o.run, o.cluster, {', '.join(f'CASE WHEN {far} THEN coalesce(w.{f}, o.{f}) ELSE o.{f} END' for f in features)},
  {far}
FROM lloyd o LEFT JOIN (
  SELECT run, cluster, {', '.join(f'CAST(sum({f}) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS {f}' for f in features)}
  FROM ({nearest('lloyd', 'WHERE c.moved')}) GROUP BY run, cluster) w ON w.run = o.run AND w.cluster = o.cluster
WHERE o.moved"""),
        ("kend", "SELECT * FROM lloyd WHERE NOT moved"),
        ("kdone", nearest("kend")),
        ("kbest", f"SELECT run FROM kdone GROUP BY run ORDER BY sum(CAST(round_even(d2 / {scale}, 0) AS BIGINT)), run LIMIT 1"),
        ("kcell", """SELECT hex_id, CAST(d.cluster AS INTEGER) AS cluster, h.congestion_impact_score
FROM kdone d JOIN kbest USING (run) JOIN hot h USING (hex_id)"""),
        ("ktier", """SELECT cluster, ['Critical', 'High', 'Medium', 'Low'][least(row_number() OVER (ORDER BY avg(congestion_impact_score) DESC, cluster), 4)]
  AS tier FROM kcell GROUP BY cluster"""),
    ]
    return ctes


SQL["tier_hotspots"] = _on_hot(
    "SELECT hex_id, cluster, tier, congestion_impact_score FROM kcell JOIN ktier USING (cluster)",
    _kmeans_sql(S.TIER_FEATURES, 4, 10, 42)).replace("WITH ", "WITH RECURSIVE ", 1)


# ---------------------------------------------------------------------------
# records of a part of the span
# ---------------------------------------------------------------------------
_week = "date BETWEEN DATE '2024-01-08' AND DATE '2024-01-14'"
SQL["period_hours"] = O.with_(_base([("week", f"SELECT * FROM hexed WHERE {_week}"), *[
    (n, q.replace("FROM hexed", "FROM week")) for n, q in O.busy_ctes()]]), "SELECT hour, n, cum_share FROM busy")
SQL["period_cells"] = O.with_(_base(), f"""SELECT hex_id, count(*) AS violation_count, sum(severity) AS severity_weighted_count,
  count(DISTINCT date) AS active_days, CAST(sum(CAST(at_junction AS BIGINT)) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS junction_fraction
FROM hexed WHERE {_week} GROUP BY hex_id""")
SQL["peak_day_slots"] = O.with_(_base([("top", """SELECT date, count(*) AS total FROM hexed GROUP BY date
ORDER BY total DESC, date LIMIT 3""")]), """SELECT date, hour, count(*) AS n, CAST(count(*) AS DOUBLE) / CAST(any_value(total) AS DOUBLE) AS share
FROM hexed JOIN top USING (date) GROUP BY date, hour""")
SQL["period_change"] = O.with_(_base([("two", """SELECT hex_id,
  count(*) FILTER (date BETWEEN DATE '2024-01-01' AND DATE '2024-01-07') AS before,
  count(*) FILTER (date BETWEEN DATE '2024-01-22' AND DATE '2024-01-28') AS after FROM hexed GROUP BY hex_id""")]),
                               "SELECT hex_id, before, after, after - before AS change FROM two WHERE before + after > 0")
SQL["cached_refresh"] = _on_hot(
    "SELECT hex_id, violation_count, congestion_impact_score, TRUE AS only_new, TRUE AS reused FROM hot")


# ---------------------------------------------------------------------------
# cells by search: the nearest of all hexagon centres near a point, without
# the formula of functions/grid.py
# ---------------------------------------------------------------------------
def _cells_by_search(cities: list[tuple[str, float, float]], resolution: int, points: str) -> list[tuple[str, str]]:
    """``searched``: each different point of ``points`` (latitude, longitude)
    with the nearest city by haversine and the nearest centre of its grid of
    pointy-top hexagons of the resolution's mean area."""
    names = ", ".join(f"({O.q(n)}, {O.d(a)}, {O.d(b)})" for n, a, b in cities)
    area = O.d(S.HEX_AREA_KM2[resolution])
    return [
        ("city", f"SELECT * FROM (VALUES {names}) AS v(city, lat0, lon0)"),
        ("point", f"SELECT DISTINCT latitude, longitude FROM {points}"),
        ("at_city", """SELECT latitude, longitude, city, lat0, lon0 FROM (
  SELECT *, row_number() OVER (PARTITION BY latitude, longitude ORDER BY
    asin(sqrt(pow(sin(radians(latitude - lat0) / 2), 2) + cos(radians(lat0)) * cos(radians(latitude)) * pow(sin(radians(longitude - lon0) / 2), 2)))) AS rn
  FROM point, city) WHERE rn = 1"""),
        ("km", f"""SELECT *, (longitude - lon0) * {O.d(S.KM_PER_DEG_LON_EQUATOR)} * cos(radians(lat0)) AS x,
  (latitude - lat0) * {O.d(S.KM_PER_DEG_LAT)} AS y, sqrt(2 * {area} / (3 * sqrt({O.d(3.0)}))) AS side FROM at_city"""),
        ("centre", """SELECT *, side * sqrt(CAST(3 AS DOUBLE)) * (q + r / CAST(2 AS DOUBLE)) AS cx, side * 1.5 * r AS cy
FROM (SELECT *, unnest(generate_series(CAST(floor(x / (side * sqrt(3)) - r / 2.0) AS BIGINT) - 1,
                                       CAST(floor(x / (side * sqrt(3)) - r / 2.0) AS BIGINT) + 2)) AS q
      FROM (SELECT *, unnest(generate_series(CAST(floor(y / (side * 1.5)) AS BIGINT) - 1, CAST(floor(y / (side * 1.5)) AS BIGINT) + 2)) AS r FROM km))"""),
        ("searched", f"""SELECT latitude, longitude, city, {resolution} || ':' || q || ':' || r AS cell FROM (
  SELECT *, row_number() OVER (PARTITION BY latitude, longitude ORDER BY (x - cx) * (x - cx) + (y - cy) * (y - cy)) AS rn FROM centre)
WHERE rn = 1"""),
    ]


SQL["hex_bin_cities"] = O.with_(_base(_cells_by_search(
    [("north", 13.02, 77.60), ("west", 12.93, 77.54), ("south", 12.90, 77.66)], 8, "clean")),
    """SELECT city || ':' || cell AS hex_id, count(*) AS n FROM clean JOIN searched USING (latitude, longitude) GROUP BY ALL""")
SQL["hex_bin"] = O.with_(_base(_cells_by_search([("origin", *S.DEFAULT_CENTER)], 9, "clean")),
                         "SELECT cell AS hex_id, count(*) AS n FROM clean JOIN searched USING (latitude, longitude) GROUP BY ALL")
SQL["stream_hex_counts"] = SQL["hex_bin"]
