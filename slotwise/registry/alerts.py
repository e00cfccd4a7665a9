"""Metric operators, alert rules and monitoring panels by name."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from slotwise.operators.series import children_of, counter_rate, matches, sum_by, sustained
from slotwise.plans import alerts
from slotwise.registry.base import AS_OF, register

STAGE = "IMAGE_INGESTION|AI"

register("threshold", lambda src: alerts.threshold_points(src).where("breach").select("rule", "series", "ts", "value"))
register("counter_rate", lambda src: counter_rate(
    src.metrics(["nifi_amount_flowfiles_received", "kafka_topic_partition_current_offset"]), 3600).select(
    "ts", "metric", "series", "value", "rate"), 6)
register("cpu_busy", lambda src: alerts.cpu_busy(src, 3600), 6)
register("ratio", lambda src: alerts.used_share(src).select("ts", "metric", "series", "used_share"), 6)
register("sustained", lambda src: sustained(
    src.metrics(["nifi_jvm_heap_usage"]).select(
        "ts", "series", "value", (F.col("value") > 0.25).alias("breach")),
    ["series"], F.lit(1800)))
register("sum_by", lambda src: sum_by(src.metrics(["kafka_consumergroup_lag"]), "topic", "partition"))
register("label_filter", lambda src: src.metrics(["nifi_amount_flowfiles_sent", "nifi_amount_items_queued"]).where(
    matches({"component_type": ("=", "ProcessGroup"), "component_name": ("=~", ".*_INGESTION"), "component_id": ("!~", "pg-e.*")})
).select("ts", "metric", "series", "value"))
register("kafka_overview", lambda src: alerts.broker_overview(src, "traffic-.*"))
register("kafka_detail", lambda src: alerts.broker_detail(src, "traffic-.*", "group-.*"))
register("label_values", alerts.topics)
register("consumer_groups", alerts.consumer_groups)
register("drill_down", lambda src: alerts.processors_of(src, STAGE, 3600), 6)
register("label_join", lambda src: children_of(
    src.metrics(["nifi_amount_items_queued"]).where(matches({"component_type": ("=", "Processor")})),
    src.metrics(["nifi_amount_flowfiles_sent"]).where(
        matches({"component_type": ("=", "ProcessGroup"), "component_name": ("=~", STAGE)})),
).select("ts", "series", "value"))
register("alert_table", alerts.alert_table, 6)
register("lag_by_partition", alerts.lag_by_partition)
register("queued_by_group", alerts.queued_by_group)
register("kafka_overview_at", lambda src: alerts.broker_overview(src, "traffic-.*", end=AS_OF, look_back=timedelta(days=2)))
register("host_overview_at", lambda src: alerts.host_overview(src, AS_OF, timedelta(days=2)))
register("flow_rates", lambda src: alerts.flow_rates(src, 3600), 6)
register("processor_rates", lambda src: alerts.processor_rates(src, STAGE, 3600), 6)
register("flow_overview", lambda src: alerts.flow_overview(src, 3600), 6)
register("host_overview", alerts.host_overview)
register("back_pressure", alerts.back_pressure)
register("processor_panels", lambda src: alerts.processor_panels(src, STAGE, 3600), 6)
