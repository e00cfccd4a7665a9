"""The derived traffic tables as DuckDB CTEs, and small text helpers."""

from __future__ import annotations

from slotwise.sources.driver_tables import METRIC_SPECS

# The newest moment of the driver's data; a 30-day window ending here covers all of it.
AS_OF = "TIMESTAMP '2024-01-30 23:59:59'"
TODAY = "TIMESTAMP '2024-01-30 00:00:00'"

RAW = """t_raw AS (
  SELECT concat('cam_', CAST(user_id AS VARCHAR)) AS camera_id, ts, time_bucket(INTERVAL 5 MINUTE, ts) AS slot,
         event_type, event_id, user_id, value, CAST(floor(value) AS DOUBLE) AS vehicles,
         CAST(json_extract_string(props, '$.k') AS INT) AS k
  FROM events)"""

SPEEDS = """t_speeds AS (
  SELECT *, CASE WHEN k % 17 = 0 THEN NULL ELSE k * CAST(0.5 AS DOUBLE) END AS speed,
         CASE event_type WHEN 'click' THEN 'Clear' WHEN 'view' THEN 'Clouds' WHEN 'error' THEN 'Rain'
                         WHEN 'signup' THEN 'Mist' ELSE 'Drizzle' END AS w
  FROM t_raw)"""

EVENTS = """t_events AS (
  SELECT camera_id, slot, slot + INTERVAL 5 MINUTE AS generated_at, 300 AS duration_sec,
         sum(vehicles) AS vehicles_count, CAST(count(speed) AS INT) AS speed_count,
         avg(speed) AS speed_avg_kmh, min(speed) AS speed_min_kmh, max(speed) AS speed_max_kmh,
         min(w) AS w_main, CAST(max(20 + k % 17) AS DOUBLE) AS w_temp, max(50 + k % 46) AS w_humidity,
         max(k % 19) * CAST(0.5 AS DOUBLE) AS w_wind, max(k) AS w_clouds
  FROM t_speeds GROUP BY camera_id, slot)"""

CAMERAS = """t_cameras AS (
  SELECT concat('cam_', CAST(c_custkey - 1 AS VARCHAR)) AS camera_id, c_name AS display_name,
         CASE WHEN n_nationkey = 7 THEN NULL ELSE n_name END AS district,
         CASE WHEN c_custkey % 20 = 0 THEN NULL ELSE 106.5 + (c_custkey % 64) * CAST(0.0078125 AS DOUBLE) END AS location_lon,
         CASE WHEN c_custkey % 20 = 0 THEN NULL ELSE 10.5 + (c_custkey % 64) * CAST(0.0078125 AS DOUBLE) END AS location_lat,
         CASE c_mktsegment WHEN 'BUILDING' THEN 'DOWN' WHEN 'MACHINERY' THEN 'NOT_IMAGE' ELSE 'UP' END AS status,
         CASE WHEN c_custkey % 2 = 0 THEN 'YES' ELSE 'NO' END AS ptz,
         CASE c_custkey % 3 WHEN 0 THEN 'FIXED' WHEN 1 THEN 'PTZ' ELSE 'DOME' END AS cam_type
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""

PREDICTS = """t_predicts AS (
  SELECT camera_id, slot,
         list_transform(range(1, 13), lambda i: vehicles_count + CAST((i * 7 + hour(slot)) % 11 AS DOUBLE) - 5) AS count_preds,
         list_transform(range(1, 13), lambda i: greatest(CAST(0 AS DOUBLE),
           coalesce(speed_avg_kmh, 25) + CAST((i * 5 + hour(slot)) % 9 AS DOUBLE) - 4)) AS avg_kmh_preds
  FROM t_events WHERE w_main <> 'Mist')"""

# The trailing window of the reports, over slots and over slots of known cameras.
WINDOWED = f"""ev AS (
  SELECT * FROM t_events WHERE slot >= {AS_OF} - INTERVAL 30 DAY AND slot < {AS_OF})"""
PLACED = "ec AS (SELECT * FROM ev JOIN t_cameras USING (camera_id))"
PAIRED = f"""pe AS (
  SELECT ev.*, count_preds[1] AS c1, avg_kmh_preds[1] AS s1, avg_kmh_preds[7] AS s7, avg_kmh_preds[12] AS s12
  FROM ev JOIN t_predicts p ON p.camera_id = ev.camera_id AND p.slot = ev.slot)"""
AHEAD = f"""pw AS (
  SELECT camera_id, slot, avg_kmh_preds[1] AS s1 FROM t_predicts
  WHERE slot >= {AS_OF} - INTERVAL 30 DAY AND slot < {AS_OF})"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


BASE = (RAW, SPEEDS, EVENTS, CAMERAS, PREDICTS, WINDOWED, PLACED, PAIRED, AHEAD)


def over(sql: str, *more: str) -> str:
    """SQL with all derived tables in front."""
    return with_(*BASE, *more) + sql


def r(value: str, digits: int = 1) -> str:
    scale = f"CAST({10 ** digits} AS DOUBLE)"
    return f"(round(({value}) * {scale}) / {scale} + CAST(0 AS DOUBLE))"


def q6(value: str) -> str:
    """Six decimals: what is left of sums taken in another order."""
    return r(value, 6)


def n(value: str) -> str:
    return f"CAST({value} AS BIGINT)"


def i(value: str) -> str:
    return f"CAST({value} AS INTEGER)"


def pct(part: str, whole: str) -> str:
    return f"CAST({part} AS DOUBLE) * 100 / nullif({whole}, 0)"


def day(value: str) -> str:
    return f"strftime({value}, '%Y-%m-%d')"


SLOW = "count(*) FILTER (WHERE speed_avg_kmh < 15)"


def dow(value: str) -> str:
    return f"CAST(dayofweek({value}) + 1 AS INTEGER)"


def day_type(value: str) -> str:
    return f"CASE WHEN isodow({value}) >= 6 THEN 'Weekend' ELSE 'Workday' END"


def period(value: str) -> str:
    return f"CASE WHEN hour({value}) BETWEEN 7 AND 9 OR hour({value}) BETWEEN 17 AND 20 THEN 'Rush Hour' ELSE 'Off-Peak' END"


def metrics_cte(*names: str) -> str:
    """Long samples of the named metrics; ``series`` is the sorted label text."""
    parts = []
    for metric, labels, value in METRIC_SPECS:
        if names and metric not in names:
            continue
        text = {k: f"({v.format(text='VARCHAR')})" for k, v in sorted(labels.items())}
        series = " || ',' || ".join(f"'{k}=' || {v}" for k, v in text.items())
        mapped = ", ".join(f"'{k}': {v}" for k, v in text.items())
        parts.append(
            f"SELECT ts, '{metric}' AS metric, MAP {{{mapped}}} AS labels, {series} AS series, "
            f"CAST({value} AS DOUBLE) AS value FROM t_raw"
        )
    return "t_metrics AS (\n" + "\nUNION ALL ".join(parts) + ")"
