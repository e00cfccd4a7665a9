"""Oracle SQL of column functions, filters and joins."""

from __future__ import annotations

from oracles.reports import BASELINE, BINS, CATEGORIES, NAMES, RISK, SCORED, SHORT, TODAY_EVENTS
from oracles.views import AS_OF, RAW, SLOW, day_type, n, over, period, q6, r, with_

SQL: dict[str, str] = {}


def raw(sql: str) -> str:
    return with_(RAW) + sql


LOCAL = "ts + INTERVAL 7 HOUR"
LOCAL_SLOT = f"time_bucket(INTERVAL 5 MINUTE, {LOCAL})"
ISO, SPACED, DASHED = "'%Y-%m-%dT%H:%M:%S'", "'%Y-%m-%d %H:%M:%S'", "'%Y-%m-%dT%H-%M-%S'"

SQL["slot_floor"] = raw("SELECT event_id, slot FROM t_raw")
SQL["slot_previous"] = raw("SELECT event_id, time_bucket(INTERVAL 5 MINUTE, ts - INTERVAL 5 MINUTE) AS slot FROM t_raw")
SQL["parse_http_date"] = raw("""
SELECT event_id, CASE WHEN event_type IN ('error', 'view') THEN ts + INTERVAL 1 HOUR ELSE date_trunc('second', ts) END AS event_time
FROM t_raw""")
SQL["to_local_time"] = raw(f"""
SELECT event_id, strftime({LOCAL_SLOT}, '%Y-%m-%d') AS local_date, strftime({LOCAL_SLOT}, {ISO}) AS local_slot,
       strftime({LOCAL}, {ISO}) AS frame_time
FROM t_raw""")
SQL["derive_paths"] = raw(f"""
SELECT event_id, 'latest/' || camera_id || '.jpg' AS latest_key, image_key,
       'raw/dt=' || d || '/weather/' || camera_id || '_' || s || '.json' AS weather_key,
       'raw/dt=' || d || '/speed/' || camera_id || '/' || s || '/' || camera_id || '_' || f || '.json' AS speed_key,
       'manifest/dt=' || d || '/' || camera_id || '/' || s || '/' || camera_id || '_' || f || '.json' AS manifest_key,
       'batch/dt=' || d || '/' || camera_id || '_' || s || '.json' AS batch_key,
       's3://traffic-data/' || image_key AS image_ref, path_slot, camera_id AS path_camera
FROM (SELECT *, 'raw/dt=' || d || '/images/' || camera_id || '_' || replace(f[:10] || 'T' || replace(f[12:], '-', ':'), 'TT', 'T') || '.jpg' AS image_key
      FROM (SELECT event_id, camera_id, {LOCAL_SLOT} AS path_slot, strftime({LOCAL_SLOT}, '%Y-%m-%d') AS d,
                   strftime({LOCAL_SLOT}, {DASHED}) AS s, strftime({LOCAL}, {DASHED}) AS f FROM t_raw) x) y""")
ROUTED = """rt AS (
  SELECT event_id, CASE event_type WHEN 'error' THEN '  ' WHEN 'signup' THEN NULL ELSE camera_id END AS camera_id,
         CASE WHEN event_type IN ('error', 'signup') THEN 'rejected' ELSE 'accepted' END AS route
  FROM t_raw)"""
SQL["require_camera"] = with_(RAW, ROUTED) + "SELECT * FROM rt"
SQL["parse_slot"] = raw(f"""
SELECT event_id, key, CASE WHEN event_type = 'error' THEN replace(key, 'T', ' ') ELSE strftime(slot, {SPACED}) END AS slot_out,
       strftime(CASE WHEN event_type = 'error' THEN {AS_OF} ELSE slot + INTERVAL 300 SECOND END, {SPACED}) AS generated_at
FROM (SELECT *, CASE WHEN event_type IN ('click', 'purchase') THEN strftime(slot, {ISO})
                     WHEN event_type = 'error' THEN strftime(slot, '%Y-%m-%dT%H:%M') ELSE strftime(slot, {SPACED}) END AS key
      FROM t_raw) x""")

STAMP, STAMP_SPACED = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')", "strftime(ts, '%Y-%m-%d %H:%M:%S.%f')"
FRAMES = f"""fr AS (
  SELECT camera_id, slot, ts, {STAMP} AS time, 's3://traffic-data/raw/images/' || event_id || '.jpg' AS image_ref
  FROM t_raw WHERE event_type IN ('view', 'click'))"""
SAMPLES = f"""sp AS (
  SELECT camera_id, slot, ts, {STAMP_SPACED} AS time, k * CAST(0.5 AS DOUBLE) AS speed
  FROM t_raw WHERE event_type <> 'view' AND k % 17 <> 0)"""
SQL["clean_frames"] = with_(RAW, FRAMES) + "SELECT camera_id, slot, time, image_ref FROM fr"
SQL["clean_speed"] = with_(RAW, SAMPLES) + "SELECT camera_id, slot, time, speed FROM sp"

# Scalars over slots
SQL["weather_fields"] = over("""
SELECT camera_id, slot, w_main AS main, w_temp AS temp, w_humidity AS humidity, w_wind AS wind_speed, w_clouds AS clouds_all
FROM t_events""")
SQL["array_at"] = over("""
SELECT camera_id, slot, count_preds[1] AS count_t1, avg_kmh_preds[1] AS speed_t1, avg_kmh_preds[7] AS speed_t7,
       avg_kmh_preds[12] AS speed_t12, avg_kmh_preds[13] AS speed_t13
FROM t_predicts""")
SQL["day_name"] = over(f"""
SELECT camera_id, slot, {NAMES}[dayofweek(slot) + 1] AS day_name, {SHORT}[dayofweek(slot) + 1] AS day_short FROM t_events""")
SQL["day_type"] = over(f"SELECT camera_id, slot, {day_type('slot')} AS day_type FROM t_events")
SQL["time_period"] = over(f"""
SELECT camera_id, slot, {period('slot')} AS period,
       CASE WHEN hour(slot) IN (7, 8, 9, 17, 18, 19) THEN 'Rush Hour' ELSE 'Off-Peak' END AS page_period
FROM t_events""")
SQL["hour_block"] = over(f"""
SELECT camera_id, slot, {n('hour(slot) // 2')} AS block2, {n('hour(slot) // 4')} AS block4 FROM t_events""")


def rank(value: str, *cuts: int) -> str:
    whens = " ".join(f"WHEN {value} < {cut} THEN {place}" for place, cut in enumerate(cuts, 1))
    return f"CAST(CASE {whens} ELSE {len(cuts) + 1} END AS INTEGER)"


def cut(value: str, *pairs, other: str) -> str:
    whens = " ".join(f"WHEN {value} < {limit} THEN '{name}'" for limit, name in pairs)
    return f"CASE {whens} ELSE '{other}' END"


SPEED = "speed_avg_kmh"
SQL["speed_bin"] = over(f"SELECT camera_id, slot, {BINS} AS label, {rank(SPEED, 10, 20, 30, 40, 50)} AS rank FROM t_events")
SQL["speed_category"] = over(
    f"SELECT camera_id, slot, {CATEGORIES} AS label, {rank(SPEED, 10, 20, 30, 50)} AS rank FROM t_events")
SQL["speed_status"] = over(f"""
SELECT camera_id, slot, {cut(SPEED, (15, 'Kẹt nặng'), (25, 'Đông xe'), (35, 'Bình thường'), other='Thông thoáng')} AS label,
       {rank(SPEED, 15, 25, 35)} AS rank
FROM t_events""")
SQL["risk_level"] = over(f"""
SELECT camera_id, slot, {RISK} AS label, {rank('s1', 10, 15, 25)} AS rank
FROM (SELECT camera_id, slot, avg_kmh_preds[1] AS s1 FROM t_predicts) x""")
SQL["traffic_light_band"] = over(f"""
SELECT camera_id, slot, {cut('vehicles_count', (20, 'green'), (60, 'yellow'), other='red')} AS volume_light,
       {cut(SPEED, (15, 'red'), (25, 'yellow'), other='green')} AS speed_light,
       {cut(SPEED, (20, 'green'), (35, 'yellow'), other='red')} AS gauge,
       {cut(SPEED, (10, 'poor'), (20, 'satisfactory'), (40, 'good'), other='excellent')} AS bullet
FROM t_events""")
SQL["alert_type"] = over("""
SELECT camera_id, slot, CASE WHEN z < -3 THEN 'Sudden Drop' WHEN z > 3 THEN 'Sudden Spike' WHEN jam THEN 'Congestion' ELSE 'Normal' END AS alert_type
FROM (SELECT camera_id, slot, CASE WHEN s > 0 THEN (vehicles_count - m) / s END AS z, coalesce(speed_avg_kmh < 15, false) AS jam
      FROM t_events JOIN (SELECT camera_id, avg(vehicles_count) AS m, stddev_samp(vehicles_count) AS s FROM t_events GROUP BY camera_id) b
      USING (camera_id)) x""")
SQL["safe_divide"] = over(f"""
SELECT camera_id, slot, {q6('CASE WHEN coalesce(speed_min_kmh, 0) = 0 THEN -1 ELSE vehicles_count / speed_min_kmh END')} AS per_kmh
FROM t_events""")
SQL["marker_size"] = over(
    f"SELECT camera_id, slot, {q6('CASE WHEN vehicles_count > 5 THEN vehicles_count ELSE 5 END / 5 + 8')} AS size FROM t_events")

# Filters
PLAIN = "camera_id, slot, vehicles_count, speed_avg_kmh"
SQL["time_range"] = over(f"""
SELECT {PLAIN} FROM t_events WHERE slot >= TIMESTAMP '2024-01-05 00:02:00' AND slot < TIMESTAMP '2024-01-25 12:03:00'""")
SQL["end_date_window"] = over(f"""
SELECT {PLAIN} FROM t_events WHERE slot >= TIMESTAMP '2024-01-07 23:59:59' AND slot < TIMESTAMP '2024-01-21 23:59:59'""")
SQL["in_list"] = over(f"SELECT {PLAIN}, district FROM ec WHERE district IN ('NATION_1', 'NATION_5', 'NATION_12')")
SQL["day_type_filter"] = over(f"SELECT {PLAIN} FROM t_events WHERE isodow(slot) IN (6, 7)")
SQL["not_null"] = over(f"SELECT {PLAIN}, district FROM ec WHERE speed_avg_kmh IS NOT NULL AND district IS NOT NULL")
SQL["nested_predicate"] = over(
    f"SELECT {PLAIN}, w_temp AS temp, w_humidity AS humidity FROM t_events WHERE w_temp > 30 AND w_humidity > 80")
SQL["having"] = over(f"""
SELECT camera_id, {n('count(*)')} AS slots, {n(SLOW)} AS slow_slots FROM t_events GROUP BY camera_id HAVING {SLOW} >= 20""")

# Joins
SQL["join_camera"] = over(f"SELECT {PLAIN}, display_name, district, status FROM t_events JOIN t_cameras USING (camera_id)")
SQL["join_predict"] = over(
    f"SELECT {PLAIN}, count_preds[1] AS count_t1 FROM t_events JOIN t_predicts USING (camera_id, slot)")
SQL["join_predict_bucketed"] = SQL["join_predict"]
SQL["join_baseline"] = over(f"""
SELECT camera_id, slot, {q6('vehicles_count')} AS vehicles_count, {q6('bl.m')} AS avg_vehicles, {q6('s')} AS std_vehicles, {q6('z')} AS z_score
FROM sc JOIN bl USING (camera_id)""", TODAY_EVENTS, BASELINE, SCORED)
SQL["left_join_today"] = over(f"""
SELECT c.camera_id, c.display_name, {n('count(te.slot)')} AS slots, max(te.slot) AS last_slot, {r('avg(speed_avg_kmh)')} AS avg_speed
FROM t_cameras c LEFT JOIN te ON te.camera_id = c.camera_id GROUP BY c.camera_id, c.display_name""", TODAY_EVENTS)
SQL["unnest"] = over(f"""
SELECT camera_id, {n('count(speed)')} AS samples, sum(speed) AS speed_sum, max(ts) FILTER (WHERE speed IS NOT NULL) AS last_time
FROM t_speeds GROUP BY camera_id HAVING count(speed) > 0""")
SQL["calendar_fill"] = f"""
SELECT strftime(d, '%Y-%m-%d') AS day, {n('cnt')} AS orders
FROM (SELECT CAST(unnest(generate_series((SELECT min(o_orderdate) FROM orders), (SELECT max(o_orderdate) FROM orders), INTERVAL 1 DAY)) AS DATE) AS d) c
LEFT JOIN (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS cnt FROM orders GROUP BY ALL) o USING (d)"""
SQL["latest_n_slots"] = over(f"""
SELECT {PLAIN} FROM t_events QUALIFY row_number() OVER (PARTITION BY camera_id ORDER BY slot DESC) <= 12""")
