"""Oracle SQL of metric operators, alert rules and monitoring panels."""

from __future__ import annotations

from oracles.views import RAW, i, metrics_cte, n, q6, with_

SQL: dict[str, str] = {}

# name, severity, hold, condition on a sample, broken
VALUE_RULES = [
    ("NiFiQueueBackPressure", "warning", 300,
     "metric = 'nifi_amount_flowfiles_queued' AND labels['component_type'] = 'ProcessGroup'", "value > 1000"),
    ("NiFiProcessorErrors", "warning", 300,
     "metric = 'nifi_amount_flowfiles_sent' AND labels['component_type'] = 'Processor' AND labels['relationship'] = 'failure'", "value > 0"),
    ("NiFiHighHeapUsage", "warning", 300, "metric = 'nifi_jvm_heap_usage'", "value > 0.80"),
    ("NiFiCriticalHeapUsage", "critical", 120, "metric = 'nifi_jvm_heap_usage'", "value > 0.92"),
    ("NiFiHighThreadCount", "warning", 300,
     "metric = 'nifi_amount_threads_active' AND labels['component_type'] = 'RootProcessGroup'", "value > 150"),
    ("CriticalMemory", "critical", 300, "metric = 'node_memory_MemAvailable_bytes'", "value < 314572800"),
    ("KafkaHighConsumerLag", "warning", 300, "metric = 'kafka_consumergroup_lag_sum'", "value > 10000"),
]


def metrics(sql: str, *more: str, names: tuple[str, ...] = ()) -> str:
    return with_(RAW, metrics_cte(*names), *more) + sql


def rated(source: str, seconds: int, alias: str) -> list[str]:
    """Increase per second: the window's steps without the first one, which starts before it."""
    return [
        f"""{alias}_step AS (
  SELECT *, coalesce(CASE WHEN value >= lag(value) OVER w THEN value - lag(value) OVER w
                          WHEN lag(value) OVER w IS NOT NULL THEN value END, 0) AS step
  FROM ({source}) x WINDOW w AS (PARTITION BY metric, series ORDER BY ts))""",
        f"""{alias} AS (
  SELECT ts, metric, labels, series, value,
         CASE WHEN count(*) OVER w >= 2 THEN (sum(step) OVER w - first_value(step) OVER w) / CAST({seconds} AS DOUBLE) END AS rate
  FROM {alias}_step
  WINDOW w AS (PARTITION BY metric, series ORDER BY ts RANGE BETWEEN INTERVAL {seconds} SECOND PRECEDING AND CURRENT ROW))""",
    ]


def _where(name: str, extra: str = "true") -> str:
    return f"SELECT * FROM t_metrics WHERE metric = '{name}' AND {extra}"


def used(free: str, total: str) -> str:
    return f"""
SELECT a.ts, a.metric, a.labels, a.series, 1 - a.value / b.value AS used_share
FROM t_metrics a JOIN t_metrics b ON a.ts = b.ts AND a.series = b.series AND a.metric = '{free}' AND b.metric = '{total}'"""


MEMORY = used("node_memory_MemAvailable_bytes", "node_memory_MemTotal_bytes")
DISK = used("node_filesystem_avail_bytes", "node_filesystem_size_bytes")
GROUP = "labels['component_type'] = 'ProcessGroup'"

SQL["threshold"] = metrics("\nUNION ALL ".join(
    f"SELECT '{name}' AS rule, series, ts, value FROM t_metrics WHERE {applies} AND {broken}"
    for name, _, _, applies, broken in VALUE_RULES))
SQL["counter_rate"] = metrics(
    f"SELECT ts, metric, series, value, {q6('rate')} AS rate FROM cr",
    *rated("SELECT * FROM t_metrics", 3600, "cr"),
    names=("nifi_amount_flowfiles_received", "kafka_topic_partition_current_offset"))
SQL["cpu_busy"] = metrics(
    f"SELECT ts, labels['instance'] AS instance, {q6('100 - avg(rate) * 100')} AS busy_pct FROM cr WHERE rate IS NOT NULL GROUP BY ALL",
    *rated("SELECT * FROM t_metrics", 3600, "cr"), names=("node_cpu_seconds_total",))
SQL["ratio"] = metrics(
    f"SELECT ts, metric, series, {q6('used_share')} AS used_share FROM ({MEMORY} UNION ALL {DISK}) x",
    names=("node_memory_MemAvailable_bytes", "node_memory_MemTotal_bytes", "node_filesystem_avail_bytes", "node_filesystem_size_bytes"))


def islands(keys: str, points: str, hold: str) -> str:
    return f"""
SELECT {keys}, min(ts) AS from_ts, max(ts) AS to_ts, {n('count(*)')} AS samples, {{value}} AS value
FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY ts)
               - row_number() OVER (PARTITION BY {keys}, breach ORDER BY ts) AS grp FROM {points}) x
WHERE breach GROUP BY {keys}, grp HAVING max(ts) - min(ts) >= to_seconds({hold})"""


SQL["sustained"] = metrics(
    islands("series", "(SELECT ts, series, value, value > 0.25 AS breach FROM t_metrics) p", "1800").format(value="arg_max(value, ts)"),
    names=("nifi_jvm_heap_usage",))

POINTS = "points AS (\n" + "\nUNION ALL ".join(
    [f"SELECT '{name}' AS rule, '{severity}' AS severity, {hold} AS hold, series, ts, value, {broken} AS breach FROM t_metrics WHERE {applies}"
     for name, severity, hold, applies, broken in VALUE_RULES]
    + ["SELECT 'NiFiPipelineStalled', 'critical', 900, series, ts, rate, coalesce(rate = 0, false) FROM stalled",
       "SELECT 'KafkaTopicNoMessages', 'info', 600, series, ts, rate, coalesce(rate = 0, false) FROM quiet"]
    + [f"SELECT '{name}', '{severity}', {hold}, series, ts, busy, busy > {limit} FROM busy"
       for name, severity, hold, limit in (("HighCPUUsage", "warning", 600, 85), ("CriticalCPUUsage", "critical", 300, 95))]
    + [f"SELECT 'LowMemory', 'warning', 300, series, ts, used_share, used_share > 0.85 FROM ({MEMORY}) m"]
    + [f"SELECT '{name}', '{severity}', 300, series, ts, used_share, used_share > {limit} FROM ({DISK}) d WHERE labels['fstype'] <> 'tmpfs'"
       for name, severity, limit in (("DiskAlmostFull", "warning", 0.80), ("DiskCritical", "critical", 0.90))]
) + ")"
STAGES = "('IMAGE_INGESTION', 'SPEED_INGESTION', 'WEATHER_INGESTION', 'BATCHING', 'AI')"
SQL["alert_table"] = metrics(
    f"SELECT rule, severity, series, from_ts, to_ts, samples, {q6('value')} AS value FROM ("
    + islands("rule, severity, hold, series", "points", "hold").format(value="arg_max(value, ts)") + ") y",
    *rated(_where("nifi_amount_flowfiles_sent", f"{GROUP} AND labels['component_name'] IN {STAGES}"), 600, "stalled"),
    *rated(_where("kafka_topic_partition_current_offset"), 300, "quiet"),
    *rated(_where("node_cpu_seconds_total", "labels['mode'] = 'idle'"), 300, "idle"),
    "busy AS (SELECT ts, 'instance=' || labels['instance'] AS series, 100 - avg(rate) * 100 AS busy FROM idle WHERE rate IS NOT NULL GROUP BY ALL)",
    POINTS)

SQL["sum_by"] = metrics(
    "SELECT ts, metric, labels['topic'] AS topic, labels['partition'] AS partition, sum(value) AS value FROM t_metrics GROUP BY ALL",
    names=("kafka_consumergroup_lag",))
SQL["lag_by_partition"] = metrics(
    "SELECT ts, labels['topic'] AS topic, labels['partition'] AS partition, sum(value) AS value FROM t_metrics GROUP BY ALL",
    names=("kafka_consumergroup_lag",))
SQL["label_filter"] = metrics(f"""
SELECT ts, metric, series, value FROM t_metrics
WHERE {GROUP} AND labels['component_name'] LIKE '%\\_INGESTION' ESCAPE '\\' AND labels['component_id'] NOT LIKE 'pg-e%'""",
    names=("nifi_amount_flowfiles_sent", "nifi_amount_items_queued"))
_LAST = "last AS (SELECT metric, series, any_value(labels) AS labels, arg_max(value, ts) AS value FROM t_metrics GROUP BY metric, series)"


def _total(metric: str, extra: str = "true") -> str:
    return f"sum(value) FILTER (WHERE metric = '{metric}' AND {extra})"


_TOPIC = "labels['topic'] LIKE 'traffic-%'"
SQL["kafka_overview"] = metrics(
    f"""
SELECT {_total('kafka_brokers')} AS brokers, {_total('kafka_topic_partitions', _TOPIC)} AS partitions,
       {_total('kafka_topic_partition_current_offset', _TOPIC)} AS produced_offset,
       {_total('kafka_consumergroup_current_offset', _TOPIC)} AS committed_offset,
       {_total('kafka_consumergroup_lag', _TOPIC)} AS consumer_lag,
       {_total('kafka_topic_partition_under_replicated_partition', _TOPIC)} AS under_replicated
FROM last""", _LAST)
SQL["kafka_detail"] = metrics(
    f"""
SELECT ts, metric, labels['topic'] AS topic, labels['partition'] AS partition, coalesce(labels['consumergroup'], '') AS consumergroup, value
FROM t_metrics WHERE {_TOPIC}""",
    names=("kafka_topic_partition_current_offset", "kafka_topic_partition_oldest_offset", "kafka_consumergroup_lag",
           "kafka_consumergroup_current_offset", "kafka_topic_partition_in_sync_replica", "kafka_topic_partition_replicas"))
SQL["label_values"] = metrics(
    "SELECT DISTINCT labels['topic'] AS topic FROM t_metrics WHERE labels['topic'] NOT IN ('__consumer_offsets', '__transaction_state', '_schemas')",
    names=("kafka_topic_partition_current_offset",))
SQL["consumer_groups"] = metrics(
    "SELECT DISTINCT labels['consumergroup'] AS consumergroup FROM t_metrics", names=("kafka_consumergroup_lag",))
_PROC = "labels['component_type'] = 'Processor'"
_CHOSEN = "labels['parent_id'] IN ('pg-click', 'pg-purchase')"
SQL["drill_down"] = metrics(
    f"SELECT ts, labels['component_name'] AS component_name, labels['parent_id'] AS parent_id, {q6('rate')} AS rate FROM cr",
    *rated(f"SELECT * FROM t_metrics WHERE {_PROC} AND {_CHOSEN}", 3600, "cr"), names=("nifi_amount_flowfiles_sent",))
SQL["label_join"] = metrics(
    f"SELECT ts, series, value FROM t_metrics WHERE {_PROC} AND {_CHOSEN}", names=("nifi_amount_items_queued",))
SQL["queued_by_group"] = metrics(
    f"SELECT ts, labels['component_name'] AS component_name, sum(value) AS value FROM t_metrics WHERE {GROUP} GROUP BY ALL",
    names=("nifi_amount_items_queued",))
SQL["flow_overview"] = metrics(
    f"""
SELECT component_name, items_queued, bytes_queued, threads, {q6('rate_in')} AS rate_in, {q6('rate_out')} AS rate_out
FROM (SELECT labels['component_name'] AS component_name, {_total('nifi_amount_items_queued')} AS items_queued,
             {_total('nifi_size_content_queued_total')} AS bytes_queued, {_total('nifi_amount_threads_active')} AS threads
      FROM last WHERE {GROUP} GROUP BY ALL) a
JOIN (SELECT labels['component_name'] AS component_name, avg(rate) FILTER (WHERE metric = 'nifi_amount_flowfiles_received') AS rate_in,
             avg(rate) FILTER (WHERE metric = 'nifi_amount_flowfiles_sent') AS rate_out
      FROM cr GROUP BY ALL) b USING (component_name)""",
    _LAST, *rated(f"SELECT * FROM t_metrics WHERE {GROUP} AND metric IN ('nifi_amount_flowfiles_received', 'nifi_amount_flowfiles_sent')", 3600, "cr"))
SQL["host_overview"] = metrics(
    f"""
SELECT labels['instance'] AS instance, {_total('nifi_amount_threads_active')} AS threads, {_total('nifi_jvm_uptime')} AS uptime,
       {_total('nifi_content_repo_used_space_bytes')} AS content_repo, {_total('nifi_flow_file_repo_used_space_bytes')} AS flow_file_repo
FROM last WHERE labels['instance'] IS NOT NULL GROUP BY ALL""", _LAST,
    names=("nifi_amount_threads_active", "nifi_jvm_uptime", "nifi_content_repo_used_space_bytes", "nifi_flow_file_repo_used_space_bytes"))
SQL["back_pressure"] = metrics(
    "SELECT ts, labels['component_name'] AS connection, value FROM t_metrics WHERE value > 0", names=("nifi_percent_used_count",))
SQL["processor_panels"] = metrics(
    f"""
SELECT component_name, {q6('sent_rate')} AS sent_rate, {q6('write_rate')} AS write_rate, {q6('duration_rate')} AS duration_rate, items_queued
FROM (SELECT labels['component_name'] AS component_name, avg(rate) FILTER (WHERE metric = 'nifi_amount_flowfiles_sent') AS sent_rate,
             avg(rate) FILTER (WHERE metric = 'nifi_amount_bytes_written') AS write_rate,
             avg(rate) FILTER (WHERE metric = 'nifi_total_task_duration') AS duration_rate
      FROM cr GROUP BY ALL) a
JOIN (SELECT labels['component_name'] AS component_name, {_total('nifi_amount_items_queued')} AS items_queued
      FROM last WHERE {_PROC} GROUP BY ALL) b USING (component_name)""",
    _LAST,
    *rated(f"SELECT * FROM t_metrics WHERE {_PROC} AND {_CHOSEN} AND metric IN ('nifi_amount_flowfiles_sent', 'nifi_amount_bytes_written', 'nifi_total_task_duration')", 3600, "cr"))


# The last values of series that spoke in the last two days before the end of the table.
_NOW = _LAST.replace("FROM t_metrics", "FROM t_metrics WHERE ts >= TIMESTAMP '2024-01-28 23:59:59' AND ts < TIMESTAMP '2024-01-30 23:59:59'")
SQL["kafka_overview_at"] = SQL["kafka_overview"].replace(_LAST, _NOW)
SQL["host_overview_at"] = SQL["host_overview"].replace(_LAST, _NOW)


def _over_time(panels: dict[str, str]) -> str:
    cases = " ".join(f"WHEN '{metric}' THEN '{panel}'" for panel, metric in panels.items())
    return (f"SELECT ts, component_name, panel, {q6('rate')} AS rate FROM (SELECT ts, labels['component_name'] AS component_name, "
            f"CASE metric {cases} END AS panel, sum(rate) AS rate FROM cr GROUP BY ALL) x")


SQL["flow_rates"] = metrics(
    _over_time({"rate_in": "nifi_amount_flowfiles_received", "rate_out": "nifi_amount_flowfiles_sent"}),
    *rated(f"SELECT * FROM t_metrics WHERE {GROUP}", 3600, "cr"), names=("nifi_amount_flowfiles_received", "nifi_amount_flowfiles_sent"))
SQL["processor_rates"] = metrics(
    _over_time({"sent_rate": "nifi_amount_flowfiles_sent", "write_rate": "nifi_amount_bytes_written", "duration_rate": "nifi_total_task_duration"}),
    *rated(f"SELECT * FROM t_metrics WHERE {_PROC} AND {_CHOSEN}", 3600, "cr"),
    names=("nifi_amount_flowfiles_sent", "nifi_amount_bytes_written", "nifi_total_task_duration"))
