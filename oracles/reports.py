"""Oracle SQL of the reports."""

from __future__ import annotations

from oracles.views import AS_OF, SLOW, TODAY, day, day_type, dow, i, n, over, pct, period, q6, r

AV, AS = r("avg(vehicles_count)"), r("avg(speed_avg_kmh)")
NAMES = "['Sunday','Monday','Tuesday','Wednesday','Thursday','Friday','Saturday']"
SHORT = "['CN','T2','T3','T4','T5','T6','T7']"

TODAY_EVENTS = f"te AS (SELECT * FROM t_events WHERE slot >= {TODAY})"
BASELINE = f"""bl AS (
  SELECT camera_id, avg(vehicles_count) AS m, stddev_samp(vehicles_count) AS s FROM t_events
  WHERE slot >= {TODAY} - INTERVAL 7 DAY AND slot < {TODAY} GROUP BY camera_id)"""
SCORED = """sc AS (
  SELECT te.*, m, CASE WHEN s > 0 THEN (vehicles_count - m) / s END AS z, coalesce(speed_avg_kmh < 15, false) AS jam
  FROM te JOIN bl USING (camera_id))"""
HOURLY = f"""hh AS (
  SELECT CAST(slot AS DATE) AS d, {i('hour(slot)')} AS hour, camera_id, district, display_name,
         {AV} AS avg_vehicles, {AS} AS avg_speed, {n('count(*)')} AS sample_count
  FROM ec GROUP BY ALL)"""
HEAT = f"""hm AS (
  SELECT *, {dow('d')} AS dow_num, {NAMES}[dayofweek(d) + 1] AS day_name, {day_type('d')} AS day_type FROM hh)"""


def category(value: str, cuts: list, labels: list[str]) -> str:
    whens = " ".join(f"WHEN {value} < {c} THEN '{name}'" for c, name in zip(cuts, labels))
    return f"CASE {whens} ELSE '{labels[-1]}' END"


BINS = category("speed_avg_kmh", [10, 20, 30, 40, 50], ["0-10", "10-20", "20-30", "30-40", "40-50", "50+"])
CATEGORIES = category(
    "speed_avg_kmh", [10, 20, 30, 50],
    ["Nguy cơ cao (<10)", "Kẹt nặng (10-20)", "Đông xe (20-30)", "Bình thường (30-50)", "Thông thoáng (>50)"],
)
RISK = category(
    "s1", [10, 15, 25], ["Nguy cơ cao (<10 km/h)", "Nguy cơ vừa (10-15)", "Cảnh báo (15-25)", "Thông thoáng (>25)"]
)

SQL: dict[str, str] = {}

# Slot reports
SQL["traffic_events"] = over("""
SELECT camera_id, slot, generated_at, duration_sec, vehicles_count, speed_count, speed_avg_kmh, speed_min_kmh,
       speed_max_kmh, w_main AS weather_main, w_temp AS weather_temp, w_humidity AS weather_humidity,
       w_wind AS weather_wind_speed, w_clouds AS weather_clouds, display_name, district, location_lon, location_lat,
       status AS camera_status, ptz, cam_type
FROM ec""")
SQL["rush_offpeak"] = over(f"SELECT district, {period('slot')} AS time_period, {AV} AS avg_vehicles FROM ec GROUP BY ALL")
SQL["heatmap_hourly"] = over(
    f"SELECT {day('d')} AS day, dow_num, day_name, day_type, hour, district, camera_id, display_name, "
    "avg_vehicles, avg_speed, sample_count FROM hm", HOURLY, HEAT)
SQL["anomalies"] = over(f"""
SELECT camera_id, display_name, district, slot, {r('vehicles_count')} AS vehicles, {r('speed_avg_kmh')} AS speed_kmh,
       {r('m')} AS baseline_avg, {r('z', 2)} AS z_score, jam AS is_congested,
       CASE WHEN z < -3 THEN 'Sudden Drop' WHEN z > 3 THEN 'Sudden Spike' WHEN jam THEN 'Congestion' ELSE 'Normal' END AS alert_type
FROM sc JOIN t_cameras USING (camera_id) WHERE abs(z) > 3 OR jam""", TODAY_EVENTS, BASELINE, SCORED)
SQL["predictions"] = over("""
SELECT camera_id, slot, vehicles_count AS actual_count, speed_avg_kmh AS actual_speed, w_main AS weather_main,
       w_temp AS weather_temp, display_name, district, location_lon, location_lat, c1 AS pred_count_t1,
       s1 AS pred_speed_t1, abs(vehicles_count - c1) AS count_error_abs
FROM pe JOIN t_cameras USING (camera_id)""")
SQL["forecast_frame"] = over("""
SELECT camera_id, slot, vehicles_count AS actual_count, speed_avg_kmh AS actual_speed, c1 AS pred_count_t1, s1 AS pred_speed_t1,
       abs(vehicles_count - c1) AS count_error_abs
FROM pe JOIN t_cameras USING (camera_id)""")
_QUALITY = f"""
SELECT c.camera_id, c.display_name, c.district, c.cam_type, c.status AS camera_status, {{ptz}}
       {n('count(te.slot)')} AS slots_today, max(te.slot) AS last_event, {AV} AS avg_vehicles
FROM t_cameras c LEFT JOIN te ON te.camera_id = c.camera_id GROUP BY ALL"""
SQL["camera_quality"] = over(_QUALITY.format(ptz="c.ptz,"), TODAY_EVENTS)
SQL["data_freshness"] = over(_QUALITY.format(ptz="") + " ORDER BY last_event NULLS FIRST", TODAY_EVENTS)
SQL["city_kpi"] = over(f"""
SELECT {day('slot')} AS day, {n('count(DISTINCT camera_id)')} AS active_cameras, {n('count(*)')} AS total_events,
       {AV} AS avg_vehicles, {AS} AS avg_speed, {r('sum(vehicles_count)', 0)} AS total_volume
FROM ev GROUP BY ALL""")
SQL["city_status"] = over(f"""
SELECT c.district, {n('count(DISTINCT c.camera_id)')} AS total_cams, {n('count(DISTINCT te.camera_id)')} AS active_cams,
       {AV} AS avg_volume, {AS} AS avg_speed, {r(pct(SLOW, 'count(*)'))} AS congestion_pct
FROM t_cameras c LEFT JOIN te ON te.camera_id = c.camera_id GROUP BY c.district""", TODAY_EVENTS)
SQL["top_congestion"] = over(f"""
SELECT display_name, district, {AV} AS avg_volume, {AS} AS avg_speed, {r(pct(SLOW, 'count(*)'))} AS congestion_pct,
       {n('count(*)')} AS event_count
FROM ec GROUP BY display_name, district ORDER BY congestion_pct DESC NULLS LAST, display_name, district LIMIT 15""")
SQL["dow_profile"] = over(f"""
SELECT {dow('slot')} AS dow_num, {SHORT}[dayofweek(slot) + 1] AS dow, {AV} AS avg_volume, {AS} AS avg_speed,
       {n('count(DISTINCT camera_id)')} AS active_cams
FROM ev GROUP BY ALL""")
SQL["flow_speed_trend"] = over(f"""
SELECT {day('slot')} AS day, {i('hour(slot)')} AS hour, {day_type('slot')} AS day_type, {AV} AS avg_volume,
       {AS} AS avg_speed, {n('count(*)')} AS event_count
FROM ev GROUP BY ALL""")
SQL["speed_bins"] = over(f"SELECT {BINS} AS speed_bin, {n('count(*)')} AS event_count, {AV} AS avg_volume FROM ev GROUP BY ALL")
SQL["hourly_pattern"] = over(f"""
SELECT {i('hour(slot)')} AS hour, {AV} AS avg_volume, {AS} AS avg_speed, {n('count(DISTINCT camera_id)')} AS active_cams
FROM ev GROUP BY ALL""")
SQL["weather_impact"] = over(f"""
SELECT w_main AS weather, {n('count(DISTINCT camera_id)')} AS cameras, {n('count(*)')} AS total_events, {AV} AS avg_volume,
       {AS} AS avg_speed, {r('avg(w_temp)')} AS avg_temp, {r('avg(w_humidity)', 0)} AS avg_humidity
FROM ev GROUP BY ALL""")
SQL["incidents_summary"] = over(f"""
SELECT district, {n('count(DISTINCT camera_id) FILTER (WHERE jam)')} AS congested_cams,
       {n('count(DISTINCT camera_id) FILTER (WHERE z < -3)')} AS sudden_drop_cams,
       {n('count(DISTINCT camera_id) FILTER (WHERE z > 3)')} AS sudden_spike_cams,
       {AS} AS city_avg_speed, {r(pct(SLOW, 'count(*)'))} AS congestion_rate
FROM sc JOIN t_cameras USING (camera_id) GROUP BY district""", TODAY_EVENTS, BASELINE, SCORED)
SQL["ml_performance"] = over(f"""
SELECT {day('slot')} AS day, {r('avg(abs(vehicles_count - c1))')} AS mae_count, {r('avg(abs(speed_avg_kmh - s1))')} AS mae_speed,
       {r('avg(c1)')} AS avg_predicted, {AV} AS avg_actual, {n('count(*)')} AS sample_count
FROM pe GROUP BY ALL""")
SQL["ml_accuracy"] = over(f"""
SELECT district, {r('avg(abs(vehicles_count - c1))')} AS mae_count, {r('avg(abs(speed_avg_kmh - s1))')} AS mae_speed,
       {r('avg(abs(vehicles_count - c1) * 100 / nullif(vehicles_count, 0))')} AS mape_count, {n('count(*)')} AS samples
FROM pe JOIN t_cameras USING (camera_id) GROUP BY district""")
SQL["operations_kpi"] = over(f"""
SELECT {n('count(DISTINCT camera_id)')} AS total_events, {AS} AS avg_speed, {r(pct(SLOW, 'count(*)'))} AS congestion_pct,
       {n("count(DISTINCT camera_id) FILTER (WHERE slot >= TIMESTAMP '2024-01-30 22:59:59')")} AS active_cams_1h,
       {r('sum(vehicles_count)', 0)} AS total_vehicles
FROM ev""")
SQL["congestion_by_district"] = over(f"""
SELECT district, {n(SLOW)} AS congestion_slots, {n('count(*)')} AS total_slots, {r(pct(SLOW, 'count(*)'))} AS congestion_rate,
       {AS} AS avg_speed
FROM ec WHERE speed_avg_kmh IS NOT NULL GROUP BY district
ORDER BY congestion_slots DESC, district NULLS LAST LIMIT 15""")
SQL["speed_distribution"] = over(
    f"SELECT {CATEGORIES} AS speed_category, {n('count(*)')} AS event_count, {AV} AS avg_vehicles FROM ev GROUP BY ALL")
SQL["traffic_scatter"] = over(f"""
SELECT district, {AV} AS avg_vehicles, {AS} AS avg_speed, {n('count(*)')} AS event_count
FROM ec WHERE district IS NOT NULL GROUP BY district""")
_WEATHER = f"""
SELECT w_main AS weather, {n('count(*)')} AS {{count}}, {AV} AS avg_vehicles, {AS} AS avg_speed,
       {r('avg(w_temp)')} AS {{temp}}, {r('avg(w_humidity)', 0)} AS {{hum}}
FROM ev GROUP BY ALL"""
SQL["weather_summary"] = over(_WEATHER.format(count="event_count", temp="avg_temp", hum="avg_humidity"))
SQL["weather_scatter"] = over(_WEATHER.format(count="sample_count", temp="temp", hum="humidity"))
SQL["weather_hourly"] = over(f"""
SELECT w_main AS weather, {i('hour(slot)')} AS hour, {n('hour(slot) // 2')} AS hour_block, {period('slot')} AS period,
       {n(SLOW)} AS congestion_count, {AV} AS avg_vehicles
FROM ev WHERE w_main = 'Rain' GROUP BY ALL""")
SQL["prediction_trend"] = over(f"""
SELECT {day('slot')} AS day, {i('hour(slot)')} AS hour, {n('hour(slot) // 4')} AS time_block, {AS} AS actual_speed,
       {r('avg(s1)')} AS pred_speed_t1, {r('avg(s7)')} AS pred_speed_t7, {r('avg(s12)')} AS pred_speed_t12,
       {r('avg(abs(speed_avg_kmh - s1))', 2)} AS mae_t1, {n('count(*)')} AS sample_count
FROM pe GROUP BY ALL""")
SQL["prediction_risk"] = over(
    f"SELECT {RISK} AS risk_level, {n('count(*)')} AS camera_count, {r('avg(s1)')} AS avg_predicted_speed FROM pw GROUP BY ALL")
SQL["prediction_congestion"] = over(f"""
SELECT display_name, district, {n('count(*) FILTER (WHERE s1 < 15)')} AS congestion_predictions,
       {n('count(*)')} AS total_predictions, {r('min(s1)')} AS min_predicted_speed
FROM pw JOIN t_cameras USING (camera_id) GROUP BY display_name, district
HAVING congestion_predictions > 0 ORDER BY congestion_predictions DESC, display_name, district LIMIT 15""")
SQL["hot_humid_speed"] = over(f"""
SELECT camera_id, {q6('avg(speed_avg_kmh)')} AS avg_speed FROM t_events WHERE w_temp > 30 AND w_humidity > 80 GROUP BY ALL""")
SQL["unnest_series"] = over("SELECT camera_id, slot, ts AS time, speed FROM t_speeds WHERE speed IS NOT NULL")
SQL["weather_condition_agg"] = over(f"""
SELECT w_main AS condition, {n('count(*)')} AS count, {q6('avg(speed_avg_kmh)')} AS avg_speed,
       {q6('avg(vehicles_count)')} AS avg_vehicles
FROM t_events GROUP BY ALL""")
SQL["rain_rows"] = over("""
SELECT camera_id, slot, vehicles_count, speed_avg_kmh, w_temp AS weather_temp, w_main AS condition
FROM t_events WHERE w_main = 'Rain'""")

# Overview page
SQL["kpi_overview"] = over(f"""
SELECT {n('count(DISTINCT camera_id)')} AS total_cams, {n('count(*)')} AS total_events, {q6('avg(speed_avg_kmh)')} AS avg_speed,
       {q6('avg(vehicles_count)')} AS avg_vehicles, {n("count(DISTINCT camera_id) FILTER (WHERE status = 'UP')")} AS up_cams,
       {q6(pct("count(DISTINCT camera_id) FILTER (WHERE status = 'UP')", 'count(DISTINCT camera_id)'))} AS health_pct
FROM ec""")
SQL["kpi_delta"] = over(f"""
SELECT *, CASE WHEN prev_speed > 0 THEN {q6('avg_speed - prev_speed')} END AS delta_speed,
       CASE WHEN prev_vehicles > 0 THEN {q6('avg_vehicles - prev_vehicles')} END AS delta_vehicles
FROM (SELECT {q6('avg(speed_avg_kmh) FILTER (WHERE cur)')} AS avg_speed, {q6('avg(speed_avg_kmh) FILTER (WHERE prev)')} AS prev_speed,
             {q6('avg(vehicles_count) FILTER (WHERE cur)')} AS avg_vehicles, {q6('avg(vehicles_count) FILTER (WHERE prev)')} AS prev_vehicles
      FROM (SELECT *, slot >= TIMESTAMP '2024-01-15 23:59:59' AS cur, slot < (SELECT max(slot) FROM ec) AS prev FROM ec) x) y""")
SQL["map_points"] = over(f"""
SELECT camera_id, display_name, district, {q6('location_lat')} AS location_lat, {q6('location_lon')} AS location_lon,
       {q6('s')} AS avg_speed, {q6('v')} AS avg_vehicles, slots,
       CASE WHEN s < 15 THEN 'red' WHEN s < 25 THEN 'yellow' WHEN s < 35 THEN 'light-green' ELSE 'green' END AS color,
       {q6('CASE WHEN v < 5 THEN 5 ELSE v END / 5 + 8')} AS size
FROM (SELECT camera_id, display_name, district, location_lat, location_lon, avg(speed_avg_kmh) AS s, avg(vehicles_count) AS v,
             {n('count(vehicles_count)')} AS slots
      FROM ec WHERE district IS NOT NULL AND location_lat IS NOT NULL GROUP BY ALL) x""")
SQL["top_busiest"] = over(f"""
SELECT display_name, district, {AV} AS avg_vehicles FROM ec WHERE district IS NOT NULL GROUP BY ALL
ORDER BY avg_vehicles DESC, display_name, district LIMIT 10""")
SQL["top_slowest"] = over(f"""
SELECT *, CASE WHEN avg_speed < 15 THEN 'red' WHEN avg_speed < 25 THEN 'yellow' ELSE 'green' END AS band
FROM (SELECT display_name, district, {AV} AS avg_vehicles, {AS} AS avg_speed FROM ec WHERE district IS NOT NULL GROUP BY ALL) x
ORDER BY avg_speed NULLS LAST, display_name, district LIMIT 10""")
SQL["district_summary"] = over(f"""
SELECT *, CASE WHEN avg_speed < 15 THEN 'Kẹt nặng' WHEN avg_speed < 25 THEN 'Đông xe' WHEN avg_speed < 35 THEN 'Bình thường'
               ELSE 'Thông thoáng' END AS condition
FROM (SELECT district, {n('count(DISTINCT camera_id)')} AS cameras, {AV} AS avg_vehicles, {AS} AS avg_speed,
             {r(pct(SLOW, 'count(*)'))} AS congestion_rate
      FROM ec WHERE district IS NOT NULL GROUP BY ALL) x
ORDER BY avg_speed NULLS LAST, district LIMIT 20""")
SQL["rush_pivot"] = over(f"""
SELECT district, {r(f"avg(vehicles_count) FILTER (WHERE {period('slot')} = 'Rush Hour')")} AS rush_hour,
       {r(f"avg(vehicles_count) FILTER (WHERE {period('slot')} = 'Off-Peak')")} AS off_peak
FROM ec WHERE district IS NOT NULL GROUP BY district""")
SQL["speed_shares"] = over(f"""
SELECT {i('no')} AS range_no, name AS speed_range, {n('cnt')} AS slots, {r(pct('cnt', 'sum(cnt) OVER ()'))} AS share_pct
FROM (SELECT no, name, (SELECT count(*) FROM ec WHERE speed_avg_kmh >= lo AND speed_avg_kmh < hi) AS cnt
      FROM (VALUES (1, '< 10 km/h', -1e9, 10), (2, '10-20 km/h', 10, 20), (3, '20-30 km/h', 20, 30),
                   (4, '30-40 km/h', 30, 40), (5, '> 40 km/h', 40, 1e9)) b(no, name, lo, hi)) x""")

# Heat-map page
SQL["district_top5"] = over(f"""
SELECT district, {q6('avg(avg_vehicles)')} AS avg_vehicles FROM hm WHERE district IS NOT NULL GROUP BY district
ORDER BY avg(avg_vehicles) DESC, district LIMIT 5""", HOURLY, HEAT)
SQL["district_options"] = over("SELECT DISTINCT district FROM ec WHERE district IS NOT NULL")
_DISTRICT_HOUR = """dh AS (
  SELECT district, hour, avg(avg_vehicles) AS v FROM hm WHERE day_type = 'Workday' AND district IS NOT NULL GROUP BY ALL)"""
SQL["heat_district_hour"] = over(
    f"SELECT district, hour, {q6('v')} AS avg_vehicles, {q6('sum(v) OVER (PARTITION BY district)')} AS district_total FROM dh",
    HOURLY, HEAT, _DISTRICT_HOUR)
SQL["heat_district_hour_wide"] = over(
    f"SELECT district, {q6('sum(v)')} AS district_total, "
    + ", ".join(f"{q6(f'max(v) FILTER (WHERE hour = {h})')} AS h{h:02d}" for h in range(24))
    + " FROM dh GROUP BY district", HOURLY, HEAT, _DISTRICT_HOUR)
SQL["heat_camera_hour"] = over(f"""
SELECT display_name, hour, {q6('v')} AS avg_vehicles, {q6('row_mean')} AS row_mean
FROM ch JOIN (SELECT display_name, avg(v) AS row_mean FROM ch GROUP BY ALL ORDER BY row_mean DESC, display_name LIMIT 20) best
     USING (display_name)""", HOURLY, HEAT,
    "ch AS (SELECT display_name, hour, avg(avg_vehicles) AS v FROM hm GROUP BY ALL)")
SQL["dow_stack_other"] = over(f"""
SELECT dow_num, day_name, CASE WHEN district IN (SELECT district FROM top6) THEN district ELSE 'Khác' END AS district,
       {q6('sum(avg_vehicles)')} AS total_vehicles
FROM wd GROUP BY ALL""", HOURLY, HEAT,
    "wd AS (SELECT * FROM hm WHERE day_type = 'Workday' AND district IS NOT NULL)",
    "top6 AS (SELECT district FROM wd GROUP BY district ORDER BY sum(avg_vehicles) DESC, district LIMIT 6)")
SQL["dow_pattern"] = over(f"""
SELECT dow_num, day_name, district, {q6('avg(avg_vehicles)')} AS avg_vehicles
FROM hm WHERE district IS NOT NULL GROUP BY ALL""", HOURLY, HEAT)
SQL["weekday_weekend"] = over(
    "SELECT " + ", ".join(
        q6(f"coalesce(avg({c}) FILTER (WHERE day_type = '{kind}'), 0)") + f" AS {kind.lower()}_{name}"
        for c, name in (("avg_vehicles", "vehicles"), ("avg_speed", "speed")) for kind in ("Workday", "Weekend")
    ) + " FROM hm", HOURLY, HEAT)

# Speed page
RUSH6 = "hour(slot) IN (7, 8, 9, 17, 18, 19)"
CELLS = f"""cell AS (
  SELECT district, {i('hour(slot)')} AS hour, avg(speed_avg_kmh) AS v FROM ec WHERE district IS NOT NULL GROUP BY ALL)"""
SQL["district_slowest5"] = over(f"""
SELECT district, {q6('avg(speed_avg_kmh)')} AS avg_speed FROM ec WHERE district IS NOT NULL GROUP BY district
ORDER BY avg(speed_avg_kmh) NULLS LAST, district LIMIT 5""")
SQL["speed_kpi"] = over(f"""
SELECT {q6('avg(speed_avg_kmh)')} AS avg_speed, {q6('quantile_cont(speed_avg_kmh, 0.05)')} AS p5_speed, {n(SLOW)} AS congested,
       {n('count(speed_avg_kmh)')} AS total, {q6(pct(SLOW, 'count(speed_avg_kmh)'))} AS congested_pct,
       {q6(f'avg(speed_avg_kmh) FILTER (WHERE {RUSH6})')} AS rush_avg
FROM ec""")
SQL["speed_histogram"] = over(f"""
SELECT {n('floor(speed_avg_kmh / 5) * 5')} AS bin_start, {n('count(*)')} AS slots
FROM ec WHERE speed_avg_kmh > 0 AND speed_avg_kmh < 60 GROUP BY ALL""")
SQL["speed_heat"] = over(
    f"SELECT district, hour, {q6('v')} AS avg_speed, {q6('avg(v) OVER (PARTITION BY district)')} AS district_mean FROM cell", CELLS)
SQL["congestion_index"] = over(f"""
SELECT district, {q6('v')} AS avg_speed, CASE WHEN v < 15 THEN 'red' WHEN v < 25 THEN 'yellow' ELSE 'green' END AS band
FROM (SELECT district, avg(speed_avg_kmh) AS v FROM ec WHERE district IS NOT NULL AND {RUSH6} GROUP BY district) x""")
SQL["speed_ma3"] = over(f"""
SELECT district, hour, {q6('v')} AS avg_speed,
       {q6('avg(v) OVER (PARTITION BY district ORDER BY hour ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)')} AS speed_ma3
FROM cell""", CELLS)
SQL["suspicious_district"] = over(f"""
SELECT district, {q6('avg(v)')} AS mean_speed, {q6('stddev_samp(v)')} AS std_speed,
       coalesce(avg(v) > 35 AND stddev_samp(v) < 3, false) AS is_suspicious
FROM cell GROUP BY district""", CELLS)

# Weather page
WET, DRY = "w_main IN ('Rain', 'Thunderstorm', 'Drizzle')", "w_main IN ('Clear', 'Clouds')"
SQL["weather_kpi"] = over(f"""
SELECT most_common, {q6('t')} AS avg_temp, {q6('rv')} AS rain_vehicles, {q6('cv')} AS clear_vehicles, {q6('rs')} AS rain_speed,
       {q6('cs')} AS clear_speed, {q6('rv - cv')} AS vehicles_diff, {q6('rs - cs')} AS speed_diff
FROM (SELECT (SELECT w_main FROM ec WHERE w_main IS NOT NULL GROUP BY w_main ORDER BY count(*) DESC, w_main LIMIT 1) AS most_common,
             avg(w_temp) AS t,
             coalesce(avg(vehicles_count) FILTER (WHERE {WET}), 0) AS rv, coalesce(avg(vehicles_count) FILTER (WHERE {DRY}), 0) AS cv,
             coalesce(avg(speed_avg_kmh) FILTER (WHERE {WET}), 0) AS rs, coalesce(avg(speed_avg_kmh) FILTER (WHERE {DRY}), 0) AS cs
      FROM ec) x""")
SQL["weather_stats"] = over(f"""
SELECT w_main AS weather_main, {q6('avg(vehicles_count)')} AS avg_vehicles, {q6('avg(speed_avg_kmh)')} AS avg_speed,
       {q6('stddev_samp(speed_avg_kmh)')} AS std_speed
FROM ec GROUP BY ALL""")
_WD = """wd AS (
  SELECT district, w_main AS weather_main, avg(speed_avg_kmh) AS v FROM ec WHERE district IS NOT NULL GROUP BY ALL)"""
SQL["weather_district"] = over(
    f"SELECT district, weather_main, {q6('v')} AS avg_speed, {q6('avg(v) OVER (PARTITION BY district)')} AS district_mean FROM wd", _WD)
CLASSES = ("Clear", "Clouds", "Rain", "Drizzle", "Thunderstorm", "Snow", "Mist", "Fog")
SQL["weather_district_wide"] = over(
    f"SELECT district, {q6('avg(v)')} AS district_mean, "
    + ", ".join(f"""{q6(f"max(v) FILTER (WHERE weather_main = '{c}')")} AS "{c}" """ for c in CLASSES)
    + " FROM wd GROUP BY district", _WD)
SQL["temp_vs_traffic"] = over(f"""
SELECT w_temp AS weather_temp, w_main AS weather_main, {q6('avg(vehicles_count)')} AS avg_vehicles,
       {n('count(vehicles_count)')} AS samples,
       {q6('count(vehicles_count) * CAST(30 AS DOUBLE) / max(count(vehicles_count)) OVER (PARTITION BY w_main) + 8')} AS size
FROM ec GROUP BY w_temp, w_main""")
SQL["humidity_scaled"] = over(f"""
SELECT weather_main, {q6('v')} AS avg_vehicles, {q6('h')} AS avg_humidity,
       {q6('(h - min(h) OVER ()) / CASE WHEN max(h) OVER () = min(h) OVER () THEN 1 ELSE max(h) OVER () - min(h) OVER () END * max(v) OVER ()')} AS humidity_scaled
FROM (SELECT w_main AS weather_main, avg(vehicles_count) AS v, avg(w_humidity) AS h FROM ec GROUP BY ALL) x""")

# Trend page
DAILY = """dd AS (
  SELECT CAST(slot AS DATE) AS d, sum(vehicles_count) AS total, avg(vehicles_count) AS mean, avg(speed_avg_kmh) AS speed,
         count(vehicles_count) AS cnt FROM ec GROUP BY ALL)"""
CALENDAR = """cal AS (
  SELECT CAST(unnest(generate_series((SELECT min(d) FROM dd), (SELECT max(d) FROM dd), INTERVAL 1 DAY)) AS DATE) AS d)"""
FULL = "fd AS (SELECT * FROM cal LEFT JOIN dd USING (d))"
SQL["trend_kpi"] = over(f"""
SELECT sum(total) AS total_vehicles, {n('count(*)')} AS total_days, {n('30')} AS expected_days, {q6('avg(total)')} AS avg_daily,
       {day('(SELECT d FROM dd ORDER BY total DESC, d LIMIT 1)')} AS peak_day, max(total) AS peak_volume
FROM dd""", DAILY)
SQL["daily_volume"] = over(f"""
SELECT {day('d')} AS day, district, coalesce(total_vehicles, 0) AS total_vehicles,
       sum(coalesce(total_vehicles, 0)) OVER (PARTITION BY d) = 0 AS day_is_empty
FROM (SELECT d, district FROM cal, (SELECT DISTINCT district FROM ec WHERE district IS NOT NULL) x) g
LEFT JOIN (SELECT CAST(slot AS DATE) AS d, district, sum(vehicles_count) AS total_vehicles FROM ec GROUP BY ALL) v USING (d, district)
""", DAILY, CALENDAR)
SQL["dow_box"] = over(f"""
SELECT {dow('slot')} AS dow_num, any_value({NAMES}[dayofweek(slot) + 1]) AS day_name, any_value(q1) AS q1,
       any_value(median) AS median, any_value(q3) AS q3, {n('count(*)')} AS n, {q6('avg(vehicles_count)')} AS mean,
       {q6('stddev_samp(vehicles_count)')} AS sd,
       {n('count(*) FILTER (WHERE vehicles_count < q1 - (q3 - q1) * 1.5 OR vehicles_count > q3 + (q3 - q1) * 1.5)')} AS outliers
FROM ec JOIN (SELECT dayofweek(slot) AS dw, {q6('quantile_cont(vehicles_count, 0.25)')} AS q1,
                     {q6('quantile_cont(vehicles_count, 0.5)')} AS median, {q6('quantile_cont(vehicles_count, 0.75)')} AS q3
              FROM ec GROUP BY ALL) b ON dayofweek(slot) = dw
GROUP BY dow_num""")
SQL["rolling_ma7"] = over(f"""
SELECT {day('d')} AS day, total AS daily_total, {q6('mean')} AS daily_avg,
       {q6('avg(total) OVER (ORDER BY d ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)')} AS ma7
FROM fd""", DAILY, CALENDAR, FULL)
SQL["mom_growth"] = f"""
SELECT month, total, {q6('(total / before - 1) * 100')} AS growth_pct
FROM (SELECT month, total, lag(total) OVER (ORDER BY month) AS before
      FROM (SELECT strftime(o_orderdate, '%Y-%m') AS month, sum(floor(o_totalprice)) AS total FROM orders GROUP BY ALL) m) x
WHERE before IS NOT NULL"""
SQL["traffic_month_growth"] = over(f"""
SELECT month, total, {q6('(total / before - 1) * 100')} AS growth_pct
FROM (SELECT month, total, lag(total) OVER (ORDER BY month) AS before
      FROM (SELECT strftime(moved, '%Y-%m') AS month, coalesce(sum(vehicles_count), 0) AS total
            FROM (SELECT *, slot - to_months(CAST(day(slot) % 3 AS INTEGER)) AS moved FROM t_events JOIN t_cameras USING (camera_id)) e
            WHERE moved >= {AS_OF} - INTERVAL 90 DAY AND moved < {AS_OF} GROUP BY ALL) m) x
WHERE before IS NOT NULL""")
SQL["completeness"] = over(f"""
SELECT {n('count(*)')} AS expected_days, {n('count(total)')} AS present_days, {n('count(*) - count(total)')} AS missing_days,
       {r(pct('count(total)', 'count(*)'))} AS complete_pct
FROM fd""", DAILY, CALENDAR, FULL)
SQL["completeness_days"] = over(f"""
SELECT {day('d')} AS day, coalesce(total, 0) AS total_vehicles, {q6('speed')} AS avg_speed, {n('cnt')} AS event_count,
       total IS NOT NULL AS has_data
FROM fd""", DAILY, CALENDAR, FULL)
