"""Oracle SQL of slot aggregation, sources and sinks."""

from __future__ import annotations

from oracles.columns import FRAMES, SAMPLES
from oracles.views import metrics_cte, CAMERAS, RAW, i, n, over, q6, r, with_

SQL: dict[str, str] = {}

WEATHER = """wx AS (
  SELECT camera_id, slot, arg_max(k, ts) AS wk FROM t_raw WHERE event_type = 'signup' GROUP BY ALL)"""
PARTS = f"""parts AS (
  SELECT coalesce(f.camera_id, s.camera_id, w.camera_id) AS camera_id, coalesce(f.slot, s.slot, w.slot) AS slot,
         {i('coalesce(fn, 0)')} AS frame_count, {i('coalesce(sn, 0)')} AS speed_count, speed_avg_kmh, speed_min_kmh, speed_max_kmh,
         frames, times, last_time, wk,
         {i("((CASE WHEN fn > 0 THEN 1 ELSE 0 END + CASE WHEN sn > 0 THEN 1 ELSE 0 END + CASE WHEN wk IS NULL THEN 0 ELSE 1 END) * 100) // 3")} AS completeness
  FROM (SELECT camera_id, slot, count(*) AS fn, string_agg(time || ' ' || image_ref, ' | ' ORDER BY time, image_ref) AS frames
        FROM fr GROUP BY ALL) f
  FULL JOIN (SELECT camera_id, slot, count(*) AS sn, avg(speed) AS speed_avg_kmh, min(speed) AS speed_min_kmh,
                    max(speed) AS speed_max_kmh, string_agg(time, ' | ' ORDER BY time, speed) AS times, max(ts) AS last_time
             FROM sp GROUP BY ALL) s ON s.camera_id = f.camera_id AND s.slot = f.slot
  FULL JOIN wx w ON w.camera_id = coalesce(f.camera_id, s.camera_id) AND w.slot = coalesce(f.slot, s.slot))"""


def parts(sql: str, *more: str) -> str:
    return with_(RAW, FRAMES, SAMPLES, WEATHER, PARTS, *more) + sql


TEMP = "CAST(20 + wk % 17 AS DOUBLE)"
TEXT = "'%Y-%m-%d %H:%M:%S'"

SQL["slot_union_join"] = parts(f"""
SELECT camera_id, slot, frame_count, speed_count, speed_avg_kmh, speed_min_kmh, speed_max_kmh, {TEMP} AS weather_temp, completeness
FROM parts""")
SQL["slot_speed_stats"] = with_(RAW, SAMPLES) + f"""
SELECT camera_id, slot, {i('count(*)')} AS count, avg(speed) AS avg_kmh, min(speed) AS min_kmh, max(speed) AS max_kmh,
       {r('avg(speed)')} AS avg_kmh_1
FROM sp GROUP BY ALL"""
SQL["slot_series"] = with_(RAW, SAMPLES) + """
SELECT camera_id, slot, string_agg(time, ' | ' ORDER BY time, speed) AS times,
       sum(speed * power(2, back)) AS ordered_sum
FROM (SELECT *, row_number() OVER (PARTITION BY camera_id, slot ORDER BY time DESC, speed DESC) - 1 AS back FROM sp) x
GROUP BY camera_id, slot"""
SQL["slot_completeness"] = parts("SELECT camera_id, slot, completeness FROM parts")
SQL["slot_frame_count"] = parts("SELECT camera_id, slot, frame_count FROM parts")
DOCUMENT = f"""
SELECT camera_id, strftime(slot, {TEXT}) AS slot, strftime(slot + INTERVAL 5 MINUTE, {TEXT}) AS generated_at, 300 AS duration_sec,
       coalesce(frames, '') AS frames, CASE WHEN speed_count > 0 THEN speed_count END AS speed_count,
       {q6('speed_avg_kmh')} AS speed_avg_kmh, speed_min_kmh, speed_max_kmh, times AS series_times,
       {TEMP} AS weather_temp, wk + 500 AS weather_id, frame_count, completeness
FROM parts"""
SQL["slot_document"] = parts(DOCUMENT)
SQL["sink_slot_json"] = parts(DOCUMENT)
SQL["batch_to_events"] = parts(f"""
SELECT camera_id, slot, slot + INTERVAL 5 MINUTE AS generated_at, 300 AS duration_sec, CAST(0 AS DOUBLE) AS vehicles_count,
       CASE WHEN speed_count > 0 THEN speed_count END AS speed_count, {q6('speed_avg_kmh')} AS speed_avg_kmh, speed_min_kmh,
       speed_max_kmh, last_time, wk + 500 AS weather_id, CASE WHEN wk IS NOT NULL THEN 'Mist' END AS weather_main,
       {TEMP} AS weather_temp, 50 + wk % 46 AS weather_humidity, wk % 19 * CAST(0.5 AS DOUBLE) AS weather_wind_speed,
       wk * 3 AS weather_wind_deg, wk AS weather_clouds_all, CAST(NULL AS INTEGER) AS weather_pressure
FROM parts""")
SQL["ingest_batch"] = f"""SELECT b.*, p.frame_count FROM ({SQL['batch_to_events']}) b
JOIN ({SQL['slot_frame_count']}) p ON b.camera_id = p.camera_id AND b.slot = p.slot
WHERE b.slot <= TIMESTAMP '2024-01-30 23:50:00'"""
SQL["flatten_slot"] = parts(f"""
SELECT camera_id, slot, CASE WHEN speed_count > 0 THEN speed_count END AS speed_count, {q6('speed_avg_kmh')} AS speed_avg_kmh,
       wk + 500 AS weather_id, CASE WHEN wk IS NOT NULL THEN 'Mist' END AS weather_main,
       wk % 19 * CAST(0.5 AS DOUBLE) AS wind_speed
FROM parts""")
SQL["default_fields"] = over(f"""
SELECT p.camera_id, p.slot, CASE WHEN w_main = 'Rain' THEN 0 ELSE vehicles_count END AS vehicles_count,
       CASE WHEN p.speed_count > 0 THEN p.speed_count END AS speed_count, CASE WHEN wk IS NOT NULL THEN 'Mist' END AS weather_main
FROM parts p JOIN t_events e ON e.camera_id = p.camera_id AND e.slot = p.slot""", FRAMES, SAMPLES, WEATHER, PARTS)

# Stored tables
PLAIN = "camera_id, slot, vehicles_count, speed_avg_kmh"
RANGE = "slot >= TIMESTAMP '2024-01-03 06:00:00' AND slot < TIMESTAMP '2024-01-28 18:00:00'"
SQL["src_events"] = over(f"SELECT {PLAIN}, w_main AS weather_main FROM t_events WHERE {RANGE}")
SQL["src_cameras"] = with_(CAMERAS) + f"""
SELECT camera_id, display_name, district, {q6('location_lon')} AS location_lon, {q6('location_lat')} AS location_lat, status, ptz, cam_type
FROM t_cameras"""
_PREDICTS = """
SELECT camera_id, slot, CAST(len(count_preds) AS INTEGER) AS steps, count_preds[1] AS count_t1, avg_kmh_preds[12] AS speed_t12
FROM t_predicts"""
SQL["src_predicts"] = over(_PREDICTS)
SQL["sink_predicts"] = over(_PREDICTS)
SQL["sink_events"] = over(f"SELECT {PLAIN}, speed_count AS samples FROM t_events")
SQL["src_metrics"] = with_(RAW, metrics_cte()) + f"""
SELECT metric, series, {n('count(value)')} AS samples, min(ts) AS first_ts, max(ts) AS last_ts, min(value) AS least, max(value) AS most
FROM t_metrics GROUP BY metric, series"""

# JSON
SQL["src_json_load"] = with_(RAW, SAMPLES) + "SELECT camera_id, strftime(slot, '%Y-%m-%dT%H:%M:%S') AS slot, time, speed FROM sp"
SQL["src_json_merge"] = with_(RAW) + f"""
SELECT camera_id, {n("count(*) FILTER (WHERE event_type <> 'view')")} AS speeds,
       {n("count(*) FILTER (WHERE event_type IN ('view', 'click'))")} AS frames
FROM t_raw GROUP BY camera_id"""
SQL["src_json_list"] = parts(
    "SELECT strftime(slot, '%Y-%m-%d') AS dt, true AS has_content FROM parts GROUP BY ALL")
SQL["src_json_new"] = parts(
    "SELECT strftime(slot, '%Y-%m-%d') AS dt, true AS has_content, true AS once FROM parts GROUP BY ALL")
SQL["src_json_weather"] = with_(RAW) + """
SELECT camera_id, strftime(slot, '%Y-%m-%dT%H:%M:%S') AS slot, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS stored_at, k + 500 AS weather_id,
       'Mist' AS weather_main, CAST(20 + k % 17 AS DOUBLE) AS weather_temp, 50 + k % 46 AS weather_humidity,
       k % 19 * CAST(0.5 AS DOUBLE) AS weather_wind_speed, k * 3 AS weather_wind_deg, k AS weather_clouds_all,
       CAST(NULL AS INTEGER) AS weather_pressure
FROM t_raw WHERE event_type = 'signup'"""
