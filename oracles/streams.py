"""Oracle SQL of the streaming jobs: the batch result less the slots still open at the end."""

from __future__ import annotations

from oracles.columns import FRAMES, ROUTED, SAMPLES
from oracles.tables import TEMP, parts
from oracles.views import RAW, i, metrics_cte, n, q6, with_

SQL: dict[str, str] = {}


def closed(newest: str, end: str = "slot + INTERVAL 5 MINUTE") -> str:
    """The watermark trails the newest event by five minutes; a window closes when it passes the end."""
    return f"{end} <= ({newest}) - INTERVAL 5 MINUTE"


SPEED_CLOSED = closed("SELECT max(ts) FROM sp")
# The slot rows see all three feeds, so the newest of any of them counts.
ALL_CLOSED = closed("""SELECT max(ts) FROM t_raw WHERE event_type IN ('view', 'click', 'signup')
  OR (event_type <> 'view' AND k % 17 <> 0)""")

# Slots carry local labels, seven hours ahead of UTC.
SQL["stream_slots"] = with_(RAW, SAMPLES) + f"""
SELECT camera_id, slot + INTERVAL 7 HOUR AS slot, {i('count(*)')} AS speed_count, avg(speed) AS speed_avg_kmh, min(speed) AS speed_min_kmh, max(speed) AS speed_max_kmh
FROM sp WHERE {SPEED_CLOSED} GROUP BY ALL"""
SQL["stream_merge"] = parts(f"""
SELECT camera_id, slot + INTERVAL 7 HOUR AS slot, slot + INTERVAL 7 HOUR + INTERVAL 5 MINUTE AS generated_at, frame_count, speed_count, {q6('speed_avg_kmh')} AS speed_avg_kmh,
       speed_min_kmh, speed_max_kmh, wk + 500 AS weather_id, {TEMP} AS weather_temp, completeness
FROM parts WHERE {ALL_CLOSED}""")
SQL["stream_close"] = parts(f"SELECT camera_id, slot + INTERVAL 7 HOUR AS slot, completeness FROM parts WHERE {ALL_CLOSED}")
SQL["stream_sink"] = with_(RAW, SAMPLES) + f"""
SELECT strftime(slot + INTERVAL 7 HOUR, '%Y-%m-%d') AS dt, {n('count(DISTINCT camera_id || slot)')} AS slots, {n('count(*)')} AS samples
FROM sp WHERE {SPEED_CLOSED} GROUP BY ALL"""
SQL["stream_folded"] = with_(RAW, SAMPLES) + f"""
SELECT strftime(ts, '%Y-%m-%d') AS dt, {n('count(*)')} AS samples, sum(speed) AS speeds FROM sp GROUP BY ALL"""
SQL["stream_late"] = with_(RAW, SAMPLES) + f""", came AS (
  SELECT *, CAST(speed * 2 AS BIGINT) % 11 = 0 AS late FROM sp),
upto AS (
  SELECT max(slot) AS slot FROM came WHERE NOT late AND {closed("SELECT max(ts) FROM came WHERE NOT late")})
SELECT camera_id, slot + INTERVAL 7 HOUR AS slot, {i('count(*)')} AS speed_count, {n('count(*) FILTER (WHERE late)')} AS late_samples,
       count(*) FILTER (WHERE NOT late) = 0 AS missed
FROM came WHERE slot <= (SELECT slot FROM upto) GROUP BY camera_id, slot HAVING count(*) FILTER (WHERE late) > 0"""
SQL["stream_last_wins"] = with_(RAW, FRAMES) + """
SELECT camera_id, max(ts) AS ts, arg_max(image_ref, ts) AS image_ref FROM fr GROUP BY camera_id"""
SQL["stream_reject"] = with_(RAW, ROUTED) + "SELECT * FROM rt"
# From the definition: in each window, the sum of the steps from sample to sample.
SQL["stream_rate"] = with_(RAW, metrics_cte("nifi_amount_flowfiles_received")) + f"""
SELECT window_start, window_start + INTERVAL 10 MINUTE AS window_end, metric, series, {n('count(*)')} AS samples,
       {q6("sum(CASE WHEN before IS NULL THEN 0 WHEN value >= before THEN value - before ELSE value END) / 600")} AS rate
FROM (SELECT *, lag(value) OVER (PARTITION BY window_start, metric, series ORDER BY ts, value) AS before
      FROM (SELECT *, time_bucket(INTERVAL 15 SECOND, ts) - back * INTERVAL 15 SECOND AS window_start
            FROM t_metrics, range(0, 40) b(back)) x) y
WHERE {closed('SELECT max(ts) FROM t_metrics', 'window_start + INTERVAL 10 MINUTE')}
GROUP BY window_start, metric, series HAVING count(*) >= 2"""
SQL["stream_source"] = with_(RAW, SAMPLES) + "SELECT camera_id, slot, time, speed FROM sp"
