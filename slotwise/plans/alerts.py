"""Alert rules and monitoring panels over the long metrics table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.operators.series import (
    children_of, counter_rate, counter_rates, label, label_values, latest, matches, matches_sql, sum_by, sustained, with_series,
)


@dataclass(frozen=True)
class Rule:
    """``form`` of ``metric`` compared with ``limit``, unbroken for ``hold`` seconds.

    Forms: ``value``; ``rate`` over ``window`` seconds; ``busy``, 100 % minus the mean idle
    rate per instance; ``used``, one minus the share of ``total``.
    """

    name: str
    severity: str
    metric: str
    test: str
    limit: float
    hold: int
    form: str = "value"
    selector: dict[str, tuple[str, str]] = field(default_factory=dict)
    window: int = 0
    total: str = ""

    def applies(self) -> str:
        """SQL text that picks the rule's samples."""
        return f"metric = '{self.metric}' AND {matches_sql(self.selector)}"


_GROUP = {"component_type": ("=", "ProcessGroup")}
_STAGES = "IMAGE_INGESTION|SPEED_INGESTION|WEATHER_INGESTION|BATCHING|AI"
_IDLE = {"mode": ("=", "idle")}
_DISK = {"fstype": ("!=", "tmpfs")}

# The deployment's alert rules.
RULES = (
    Rule("NiFiQueueBackPressure", "warning", "nifi_amount_flowfiles_queued", ">", 1000, 300, selector=_GROUP),
    Rule("NiFiPipelineStalled", "critical", "nifi_amount_flowfiles_sent", "==", 0, 900, "rate",
         {**_GROUP, "component_name": ("=~", _STAGES)}, 600),
    Rule("NiFiProcessorErrors", "warning", "nifi_amount_flowfiles_sent", ">", 0, 300,
         selector={"component_type": ("=", "Processor"), "relationship": ("=", "failure")}),
    Rule("NiFiHighHeapUsage", "warning", "nifi_jvm_heap_usage", ">", 0.80, 300),
    Rule("NiFiCriticalHeapUsage", "critical", "nifi_jvm_heap_usage", ">", 0.92, 120),
    Rule("NiFiHighThreadCount", "warning", "nifi_amount_threads_active", ">", 150, 300,
         selector={"component_type": ("=", "RootProcessGroup")}),
    Rule("HighCPUUsage", "warning", "node_cpu_seconds_total", ">", 85, 600, "busy", _IDLE, 300),
    Rule("CriticalCPUUsage", "critical", "node_cpu_seconds_total", ">", 95, 300, "busy", _IDLE, 300),
    Rule("LowMemory", "warning", "node_memory_MemAvailable_bytes", ">", 0.85, 300, "used",
         total="node_memory_MemTotal_bytes"),
    Rule("CriticalMemory", "critical", "node_memory_MemAvailable_bytes", "<", 300 * 1024 * 1024, 300),
    Rule("DiskAlmostFull", "warning", "node_filesystem_avail_bytes", ">", 0.80, 300, "used", _DISK,
         total="node_filesystem_size_bytes"),
    Rule("DiskCritical", "critical", "node_filesystem_avail_bytes", ">", 0.90, 300, "used", _DISK,
         total="node_filesystem_size_bytes"),
    Rule("KafkaHighConsumerLag", "warning", "kafka_consumergroup_lag_sum", ">", 10000, 300),
    Rule("KafkaTopicNoMessages", "info", "kafka_topic_partition_current_offset", "==", 0, 600, "rate", window=300),
)


def _judge(points: DataFrame, rules: list[tuple[Rule, str]], value: str) -> DataFrame:
    """Each point once per rule it falls under: rule, series, ts, value, breach. One pass for all rules."""
    by_samples: dict[str, list[str]] = {}
    for rule, applies in rules:
        entry = f"named_struct('rule', '{rule.name}', 'breach', coalesce({value} {rule.test} {rule.limit}D, false))"
        by_samples.setdefault(applies, []).append(entry)
    none = "CAST(array() AS ARRAY<STRUCT<rule: STRING, breach: BOOLEAN>>)"
    lists = [f"CASE WHEN {applies} THEN array({', '.join(found)}) ELSE {none} END" for applies, found in by_samples.items()]
    return points.selectExpr("ts", "series", f"{value} AS value", f"inline(concat({', '.join(lists)}))")


def _per_rule(rules, attribute: str) -> Column:
    """A rule's attribute, looked up by its name."""
    quote = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    whens = " ".join(f"WHEN '{r.name}' THEN {quote(getattr(r, attribute))}" for r in rules)
    return F.expr(f"CASE rule {whens} END")


def _of(rules, form: str) -> list[Rule]:
    return [r for r in rules if r.form == form]


def threshold_points(src, rules=RULES, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """Samples under the plain threshold rules."""
    chosen = _of(rules, "value")
    samples = with_series(src.metrics(sorted({r.metric for r in chosen}), start, end))
    return _judge(samples, [(r, r.applies()) for r in chosen], "value")


def cpu_busy(src, window: int = 300, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """Busy percentage per instant and instance: 100 minus the mean idle rate of its processors."""
    idle = src.metrics(["node_cpu_seconds_total"], start, end).where(matches(_IDLE))
    return (
        counter_rate(idle, window)
        .where(F.col("rate").isNotNull())
        .groupBy("ts", label("instance").alias("instance"))
        .agg((F.lit(100.0) - F.avg("rate") * 100).alias("busy_pct"))
    )


def used_share(src, rules=RULES, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """One minus free / total where both are known at the same instant for the same labels."""
    pairs = sorted({(r.metric, r.total) for r in _of(rules, "used")})
    names = sorted({name for pair in pairs for name in pair})
    what = F.when(F.lit(False), "")
    for free, total in pairs:
        what = what.when(F.col("metric").isin(free, total), F.lit(free))
    is_free = F.col("metric").isin(*[free for free, _ in pairs])
    grouped = (
        with_series(src.metrics(names, start, end))
        .groupBy("ts", what.alias("metric"), "series", "labels")
        .agg(
            F.max(F.when(is_free, F.col("value"))).alias("free"),
            F.max(F.when(~is_free, F.col("value"))).alias("total"),
        )
    )
    share = F.lit(1.0) - F.try_divide(F.col("free"), F.col("total"))
    return grouped.withColumn("used_share", share).where(F.col("used_share").isNotNull())


def rate_points(src, rules=RULES, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """Samples under the counter-rate rules: one read and one pass for all windows."""
    chosen = _of(rules, "rate")
    windows = sorted({r.window for r in chosen})
    wanted = ", ".join(
        f"CASE WHEN {' OR '.join(f'({r.applies()})' for r in chosen if r.window == w)} THEN {w} END" for w in windows
    )
    samples = with_series(src.metrics(sorted({r.metric for r in chosen}), start, end)).selectExpr(
        "*", f"explode(array_compact(array({wanted}))) AS window"
    )
    rated = counter_rates(samples, windows, ["labels"])
    return _judge(rated, [(r, f"window = {r.window} AND {r.applies()}") for r in chosen], "rate")


def alert_points(src, rules=RULES, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """Every evaluated point of every rule: rule, series, ts, value, breach.

    One read per form of rule, and these read different metrics: gauges are judged as they
    stand, free and total amounts meet first, counters take one pass for all windows.
    """
    frames = []
    if _of(rules, "value"):
        frames.append(threshold_points(src, rules, start, end))
    if _of(rules, "rate"):
        frames.append(rate_points(src, rules, start, end))
    for window in sorted({r.window for r in _of(rules, "busy")}):
        here = [(r, "true") for r in _of(rules, "busy") if r.window == window]
        busy = cpu_busy(src, window, start, end).selectExpr("ts", "concat('instance=', instance) AS series", "busy_pct")
        frames.append(_judge(busy, here, "busy_pct"))
    if _of(rules, "used"):
        here = [(r, r.applies()) for r in _of(rules, "used")]
        frames.append(_judge(used_share(src, rules, start, end), here, "used_share"))
    points = frames[0]
    for frame in frames[1:]:
        points = points.unionByName(frame)
    return points


def alert_table(
    src, rules=RULES, start: datetime | None = None, end: datetime | None = None, panes: Sequence[int] = (3600,)
) -> DataFrame:
    """Fired alerts: rule, severity, series, first and last instant, samples, last value.

    ``panes`` are those of :func:`sustained`; the default holds some hundred samples of a
    scraped series. Take shorter ones where series are denser.
    """
    fired = sustained(alert_points(src, rules, start, end), ["rule", "series"], _per_rule(rules, "hold"), panes)
    return fired.withColumn("severity", _per_rule(rules, "severity"))


# Every panel takes the range it shows, ``[start, end)``, which reaches the ``dt`` partitions;
# an open side is open. A gauge is read at the end of the range: a series that said nothing
# in the last LOOK_BACK of it has stopped and is left out. Without an end, a series' last
# value counts however old it is.

LOOK_BACK = timedelta(minutes=5)


def _gauges(src, names, end: datetime | None, look_back: timedelta) -> DataFrame:
    return src.metrics(names, None if end is None else end - look_back, end)


# Message-broker panels

INTERNAL_TOPICS = "__consumer_offsets|__transaction_state|_schemas"
_BROKER = {"instance": ("=", "kafka")}


def broker_overview(src, topic: str = ".*", group: str = ".*", end: datetime | None = None, look_back: timedelta = LOOK_BACK) -> DataFrame:
    """One row: brokers, partitions, produced and committed offsets, lag, under-replicated partitions."""
    by_topic = {**_BROKER, "topic": ("=~", topic)}
    by_group = {**by_topic, "consumergroup": ("=~", group)}
    # Metric per panel.
    panels = {
        "brokers": ("kafka_brokers", _BROKER),
        "partitions": ("kafka_topic_partitions", by_topic),
        "produced_offset": ("kafka_topic_partition_current_offset", by_topic),
        "committed_offset": ("kafka_consumergroup_current_offset", by_topic),
        "consumer_lag": ("kafka_consumergroup_lag", by_group),
        "under_replicated": ("kafka_topic_partition_under_replicated_partition", by_topic),
    }
    samples = _gauges(src, [metric for metric, _ in panels.values()], end, look_back)
    panel = F.when(F.lit(False), "")
    for name, (metric, selector) in panels.items():
        panel = panel.when((F.col("metric") == metric) & matches(selector), F.lit(name))
    last = latest(samples.withColumn("panel", panel).where(F.col("panel").isNotNull()), F.col("panel"))
    return last.agg(*[F.sum(F.when(F.col("panel") == name, F.col("value"))).alias(name) for name in panels])


def broker_detail(src, topic: str = ".*", group: str = ".*", start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """Per-partition samples of offsets, lag and replicas."""
    names = [
        "kafka_topic_partition_current_offset", "kafka_topic_partition_oldest_offset", "kafka_consumergroup_lag",
        "kafka_consumergroup_current_offset", "kafka_topic_partition_in_sync_replica", "kafka_topic_partition_replicas",
    ]
    grouped = F.col("metric").startswith("kafka_consumergroup")
    chosen = src.metrics(names, start, end).where(
        matches({**_BROKER, "topic": ("=~", topic)}) & (~grouped | matches({"consumergroup": ("=~", group)}))
    )
    return chosen.select(
        "ts", "metric", label("topic").alias("topic"), label("partition").alias("partition"),
        label("consumergroup").alias("consumergroup"), "value",
    )


def lag_by_partition(src, group: str = ".*", start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    lag = src.metrics(["kafka_consumergroup_lag"], start, end).where(matches({**_BROKER, "consumergroup": ("=~", group)}))
    return sum_by(lag, "topic", "partition").drop("metric")


def topics(src, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """Topic names for a picker, without the broker's internal ones."""
    offsets = src.metrics(["kafka_topic_partition_current_offset"], start, end)
    return label_values(offsets.where(matches({**_BROKER, "topic": ("!~", INTERNAL_TOPICS)})), "topic")


def consumer_groups(src, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    return label_values(src.metrics(["kafka_consumergroup_lag"], start, end).where(matches(_BROKER)), "consumergroup")


# Flow panels

_PROCESSOR = {"component_type": ("=", "Processor")}
# Metric per rate panel.
_MOVED = {"rate_in": "nifi_amount_flowfiles_received", "rate_out": "nifi_amount_flowfiles_sent"}
_WORKED = {
    "sent_rate": "nifi_amount_flowfiles_sent",
    "write_rate": "nifi_amount_bytes_written",
    "duration_rate": "nifi_total_task_duration",
}


def queued_by_group(src, stages: str = _STAGES, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """Items queued per process group and instant; duplicate series of a group add up."""
    chosen = src.metrics(["nifi_amount_items_queued"], start, end).where(matches({**_GROUP, "component_name": ("=~", stages)}))
    return sum_by(chosen, "component_name").drop("metric")


def processors_of(src, group: str, window: int = 300, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """Sent rate of the processors that belong to the process groups matching ``group``."""
    sent = src.metrics(["nifi_amount_flowfiles_sent"], start, end)
    parents = sent.where(matches({**_GROUP, "component_name": ("=~", group)}))
    chosen = children_of(sent.where(matches(_PROCESSOR)), parents)
    return counter_rate(chosen, window).select(
        "ts", label("component_name").alias("component_name"), label("parent_id").alias("parent_id"), "rate"
    )


def flow_rates(src, window: int = 300, stages: str = _STAGES, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """Per process group and instant, the rates in and out."""
    chosen = src.metrics(_MOVED.values(), start, end).where(matches({**_GROUP, "component_name": ("=~", stages)}))
    return _rates_over_time(chosen, _MOVED, window)


def processor_rates(src, group: str, window: int = 300, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """Per processor of a group and instant, the sent, written and busy rates."""
    parents = src.metrics(["nifi_amount_flowfiles_sent"], start, end).where(matches({**_GROUP, "component_name": ("=~", group)}))
    counters = children_of(src.metrics(_WORKED.values(), start, end).where(matches(_PROCESSOR)), parents)
    return _rates_over_time(counters, _WORKED, window)


def _rates_over_time(counters: DataFrame, names: dict[str, str], window: int) -> DataFrame:
    panel = F.element_at(F.create_map(*[F.lit(x) for name, metric in names.items() for x in (metric, name)]), F.col("metric"))
    return counter_rate(counters, window).groupBy("ts", label("component_name").alias("component_name"), panel.alias("panel")).agg(
        F.sum("rate").alias("rate")
    )


def flow_overview(src, window: int = 300, stages: str = _STAGES, start: datetime | None = None, end: datetime | None = None, look_back: timedelta = LOOK_BACK) -> DataFrame:
    """Per process group: last queue sizes and threads, and mean rates in and out."""
    chosen = {**_GROUP, "component_name": ("=~", stages)}
    # Metric per gauge.
    gauges = {
        "items_queued": "nifi_amount_items_queued",
        "bytes_queued": "nifi_size_content_queued_total",
        "threads": "nifi_amount_threads_active",
    }
    rates = _MOVED
    group = label("component_name").alias("component_name")
    last = latest(_gauges(src, gauges.values(), end, look_back).where(matches(chosen)), group)
    now = last.groupBy("component_name").agg(
        *[F.sum(F.when(F.col("metric") == metric, F.col("value"))).alias(name) for name, metric in gauges.items()]
    )
    moved = counter_rate(src.metrics(rates.values(), start, end).where(matches(chosen)), window)
    speed = moved.groupBy(group).agg(
        *[F.avg(F.when(F.col("metric") == metric, F.col("rate"))).alias(name) for name, metric in rates.items()]
    )
    return now.join(speed, "component_name", "full").orderBy("component_name")


def back_pressure(src, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """Connections whose queue is filling: samples above 0 %."""
    links = src.metrics(["nifi_percent_used_count"], start, end).where(matches({"component_type": ("=", "Connection")}))
    return links.where(F.col("value") > 0).select("ts", label("component_name").alias("connection"), "value")


def host_overview(src, end: datetime | None = None, look_back: timedelta = LOOK_BACK) -> DataFrame:
    """Last value per host of threads, uptime and repository sizes."""
    # Metric per panel.
    panels = {
        "threads": "nifi_amount_threads_active",
        "uptime": "nifi_jvm_uptime",
        "content_repo": "nifi_content_repo_used_space_bytes",
        "flow_file_repo": "nifi_flow_file_repo_used_space_bytes",
    }
    samples = _gauges(src, panels.values(), end, look_back).where(label("instance") != "")
    last = latest(samples, label("instance").alias("instance"))
    return last.groupBy("instance").agg(
        *[F.sum(F.when(F.col("metric") == metric, F.col("value"))).alias(name) for name, metric in panels.items()]
    ).orderBy("instance")


def processor_panels(
    src, group: str, window: int = 300, start: datetime | None = None, end: datetime | None = None,
    look_back: timedelta = LOOK_BACK,
) -> DataFrame:
    """Per processor of a group: sent, written and busy rates, and the last queue size."""
    parents = src.metrics(["nifi_amount_flowfiles_sent"], start, end).where(matches({**_GROUP, "component_name": ("=~", group)}))
    rates = _WORKED
    name = label("component_name").alias("component_name")
    counters = children_of(src.metrics(rates.values(), start, end).where(matches(_PROCESSOR)), parents)
    moved = counter_rate(counters, window).groupBy(name).agg(
        *[F.avg(F.when(F.col("metric") == metric, F.col("rate"))).alias(column) for column, metric in rates.items()]
    )
    queued = children_of(_gauges(src, ["nifi_amount_items_queued"], end, look_back).where(matches(_PROCESSOR)), parents)
    last = latest(queued, name).groupBy("component_name").agg(F.sum("value").alias("items_queued"))
    return moved.join(last, "component_name", "full").orderBy("component_name")
