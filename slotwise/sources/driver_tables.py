"""The traffic tables derived from the driver's star-schema tables.

Cameras come from ``customer``, slots from ``events`` (one raw record per row), forecasts
from the slots and metric samples from ``events`` again, so all work grows with the data.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise import schemas
from slotwise.functions.timekeys import first_slot_at_or_after
from slotwise.operators.joins import broadcast_below, scan_bytes
from slotwise.operators.slots import KEYS, pack
from slotwise.sources.tables import in_range

# Parquet expands in memory; a factor this large covers the camera columns.
EXPANSION = 8
# Spark's default size of an input split.
SPLIT_BYTES = 128 * 1024 * 1024

# Metric samples per raw event: metric, labels, value. The label values and the value are
# SQL text both engines read, so the test oracle sees the same samples.
_GROUP = (
    "CASE event_type WHEN 'click' THEN 'IMAGE_INGESTION' WHEN 'view' THEN 'SPEED_INGESTION' "
    "WHEN 'error' THEN 'WEATHER_INGESTION' WHEN 'signup' THEN 'BATCHING' ELSE 'AI' END"
)
_TOPIC = (
    "CASE event_type WHEN 'click' THEN 'traffic-images' WHEN 'view' THEN 'traffic-speed' "
    "WHEN 'error' THEN 'traffic-weather' WHEN 'signup' THEN 'metrics' ELSE '__consumer_offsets' END"
)
_PGROUP = {"component_id": "concat('pg-', event_type)", "component_name": _GROUP, "component_type": "'ProcessGroup'"}
_PROCESSOR = {
    "component_name": "concat('proc-', event_type)",
    "component_type": "'Processor'",
    "parent_id": "concat('pg-', event_type)",
}
_FAILED = {**_PROCESSOR, "relationship": "'failure'"}
_LINK = {"component_name": "concat('link-', event_type)", "component_type": "'Connection'"}
_HOST = {"instance": "concat('host-', event_type)"}
_PARTITION = {"instance": "'kafka'", "partition": "CAST(user_id % 4 AS {text})", "topic": _TOPIC}
_CONSUMER = {"consumergroup": "concat('group-', event_type)", **_PARTITION}

METRIC_SPECS: list[tuple[str, dict[str, str], str]] = [
    ("nifi_amount_flowfiles_queued", _PGROUP, "floor(value) * 50"),
    ("nifi_amount_flowfiles_sent", _PGROUP, "floor(event_id / 40) % 500"),
    ("nifi_amount_flowfiles_sent", _FAILED, "k % 3"),
    ("nifi_amount_flowfiles_received", _PGROUP, "event_id % 5000"),
    ("nifi_amount_items_queued", _PGROUP, "floor(value)"),
    ("nifi_amount_items_queued", _PROCESSOR, "k"),
    ("nifi_size_content_queued_total", _PGROUP, "floor(value) * 1024"),
    ("nifi_amount_threads_active", {"component_type": "'RootProcessGroup'", **_HOST}, "k * 2"),
    ("nifi_amount_threads_active", _PGROUP, "k % 8"),
    ("nifi_percent_used_count", _LINK, "greatest(k - 40, 0)"),
    ("nifi_amount_bytes_written", _PROCESSOR, "event_id * 512"),
    ("nifi_total_task_duration", _PROCESSOR, "event_id * 16"),
    ("nifi_jvm_heap_usage", _HOST, "k * 0.0078125"),
    ("nifi_jvm_uptime", _HOST, "event_id * 1000"),
    ("nifi_content_repo_used_space_bytes", _HOST, "k * 4096"),
    ("nifi_flow_file_repo_used_space_bytes", _HOST, "k * 2048"),
    ("node_cpu_seconds_total", {"cpu": "CAST(k % 2 AS {text})", **_HOST, "mode": "'idle'"}, "event_id * 8 + k"),
    ("node_memory_MemAvailable_bytes", _HOST, "k * 16777216"),
    ("node_memory_MemTotal_bytes", _HOST, "100 * 16777216"),
    ("node_filesystem_avail_bytes", {"fstype": "CASE WHEN k % 5 = 0 THEN 'tmpfs' ELSE 'ext4' END", **_HOST}, "k * 1048576"),
    ("node_filesystem_size_bytes", {"fstype": "CASE WHEN k % 5 = 0 THEN 'tmpfs' ELSE 'ext4' END", **_HOST}, "100 * 1048576"),
    ("kafka_consumergroup_lag_sum", {"consumergroup": "concat('group-', event_type)", "topic": _TOPIC}, "floor(value) * 500"),
    ("kafka_consumergroup_lag", _CONSUMER, "floor(value)"),
    ("kafka_consumergroup_current_offset", _CONSUMER, "floor(event_id / 64)"),
    ("kafka_brokers", {"instance": "'kafka'"}, "1"),
    ("kafka_topic_partitions", {"instance": "'kafka'", "topic": _TOPIC}, "4"),
    ("kafka_topic_partition_current_offset", _PARTITION, "floor(event_id / 32)"),
    ("kafka_topic_partition_oldest_offset", _PARTITION, "floor(event_id / 128)"),
    ("kafka_topic_partition_under_replicated_partition", _PARTITION, "k % 2"),
    ("kafka_topic_partition_in_sync_replica", _PARTITION, "1 + k % 2"),
    ("kafka_topic_partition_replicas", _PARTITION, "2"),
]

# The raw record's columns. `_SLOT` is the expression of timekeys.slot_floor as text.
_SLOT = "ts - make_dt_interval(0, 0, minute(ts) % 5, extract(SECOND FROM ts))"
_K = "CAST(get_json_object(props, '$.k') AS INT)"
_SPEED = "CASE WHEN k % 17 = 0 THEN NULL ELSE k * 0.5D END"
_MAIN = (
    "CASE event_type WHEN 'click' THEN 'Clear' WHEN 'view' THEN 'Clouds' WHEN 'error' THEN 'Rain' "
    "WHEN 'signup' THEN 'Mist' ELSE 'Drizzle' END"
)


# The classes in name order: the smallest code is the smallest name, and numbers aggregate by hash.
_CLASSES = "array('Clear', 'Clouds', 'Drizzle', 'Mist', 'Rain')"
_CODE = "CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'error' THEN 5 WHEN 'signup' THEN 4 ELSE 3 END"


class DriverTables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._schemas: dict[str, schemas.T.StructType] = {}

    def schema(self, name: str) -> schemas.T.StructType:
        """Read from the files once; later scans of the same table do without that job."""
        if name not in self._schemas:
            self._schemas[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet").schema
        return self._schemas[name]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.schema(name)).parquet(f"{self.sf_dir}/{name}.parquet")

    def raw(self, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
        """One record per driver event, with its slot.

        Slot bounds become bounds on ``ts`` itself, so they reach the Parquet scan.
        """
        align = lambda moment: None if moment is None else first_slot_at_or_after(moment)
        events = in_range(self.table("events"), "ts", align(start), align(end))
        return events.selectExpr(
            "concat('cam_', CAST(user_id AS STRING)) AS camera_id",
            "ts",
            f"{_SLOT} AS slot",
            "event_type",
            "event_id",
            "user_id",
            "value",
            "CAST(floor(value) AS DOUBLE) AS vehicles",
            f"{_K} AS k",
        )

    def samples(self, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
        """Every usable speed sample, in long form."""
        return (
            self.raw(start, end)
            .selectExpr(*KEYS, "ts AS time", f"{_SPEED} AS speed")
            .where("speed IS NOT NULL")
        )

    def events(self, start: datetime | None = None, end: datetime | None = None, series: bool = False) -> DataFrame:
        """The events table; ``speed_series`` is packed only on request, as it gathers records."""
        rows = self.raw(start, end).selectExpr(*KEYS, "vehicles", "k", f"{_SPEED} AS speed", f"{_CODE} AS code")
        measures = [
            "sum(vehicles) AS vehicles_count",
            "CAST(count(speed) AS INT) AS speed_count",
            "avg(speed) AS speed_avg_kmh",
            "min(speed) AS speed_min_kmh",
            "max(speed) AS speed_max_kmh",
            "min(code) AS code",
            "CAST(max(20 + k % 17) AS DOUBLE) AS temp",
            "max(50 + k % 46) AS humidity",
            "max(k % 19 * 0.5D) AS wind_speed",
            "max(k) AS clouds_all",
        ]
        slots = rows.groupBy(*KEYS).agg(*map(F.expr, measures))
        if series:
            slots = slots.join(pack(self.samples(start, end), "speed_series", ["time", "speed"]), KEYS, "left")
        known = {c: c for c in ("temp", "humidity", "wind_speed", "clouds_all")} | {"main": f"element_at({_CLASSES}, code)"}
        weather = ", ".join(
            f"'{f.name}', CAST({known.get(f.name, 'NULL')} AS {f.dataType.simpleString()})"
            for f in schemas.WEATHER.fields
        )
        return slots.selectExpr(
            *KEYS,
            "slot + INTERVAL 5 MINUTES AS generated_at",
            "300 AS duration_sec",
            "vehicles_count", "speed_count", "speed_avg_kmh", "speed_min_kmh", "speed_max_kmh",
            "speed_series" if series else f"CAST(NULL AS {schemas.SERIES.simpleString()}) AS speed_series",
            f"named_struct({weather}) AS weather",
        )

    def cameras(self) -> DataFrame:
        customer, nation = self.table("customer"), self.table("nation")
        nation = broadcast_below(nation, scan_bytes(nation) * EXPANSION)
        place = "CASE WHEN c_custkey % 20 <> 0 THEN {base}D + c_custkey % 64 * 0.0078125D END AS {name}"
        cameras = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).selectExpr(
            "concat('cam_', CAST(c_custkey - 1 AS STRING)) AS camera_id",
            "c_name AS display_name",
            "CASE WHEN n_nationkey <> 7 THEN n_name END AS district",
            place.format(base=106.5, name="location_lon"),
            place.format(base=10.5, name="location_lat"),
            "CASE c_mktsegment WHEN 'BUILDING' THEN 'DOWN' WHEN 'MACHINERY' THEN 'NOT_IMAGE' ELSE 'UP' END AS status",
            "CASE WHEN c_custkey % 2 = 0 THEN 'YES' ELSE 'NO' END AS ptz",
            "CASE c_custkey % 3 WHEN 0 THEN 'FIXED' WHEN 1 THEN 'PTZ' ELSE 'DOME' END AS cam_type",
        )
        return broadcast_below(cameras, scan_bytes(customer) * EXPANSION)

    def predicts(self, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
        """Forecasts for every slot whose weather is not mist, so the join has gaps."""
        count = "vehicles_count + CAST((i * 7 + hour(slot)) % 11 AS DOUBLE) - 5"
        speed = "greatest(0D, coalesce(speed_avg_kmh, 25D) + CAST((i * 5 + hour(slot)) % 9 AS DOUBLE) - 4)"
        return (
            self.events(start, end)
            .where("weather.main <> 'Mist'")
            .selectExpr(
                *KEYS,
                f"transform(sequence(1, 12), i -> {count}) AS count_preds",
                f"transform(sequence(1, 12), i -> {speed}) AS avg_kmh_preds",
            )
        )

    def metrics(
        self, names: Iterable[str] | None = None, start: datetime | None = None, end: datetime | None = None
    ) -> DataFrame:
        """Long metric samples; only the named metrics are generated.

        Each distinct label text is computed once per event, and metrics with the same
        labels share one map.
        """
        wanted = None if names is None else set(names)
        texts: dict[str, str] = {}
        by_labels: dict[str, list[str]] = {}
        for metric, labels, value in METRIC_SPECS:
            if wanted is not None and metric not in wanted:
                continue
            pairs, series = [], []
            for name, text in sorted(labels.items()):
                column = texts.setdefault(text.format(text="STRING"), f"_l{len(texts)}")
                pairs.append(f"'{name}', {column}")
                series.append(f"'{name}=', {column}")
            comma = ", ',', "
            keyed = f"'labels', map({', '.join(pairs)}), 'series', concat({comma.join(series)})"
            point = f"named_struct('metric', '{metric}', 'value', CAST({value} AS DOUBLE))"
            by_labels.setdefault(keyed, []).append(point)
        sets = [f"named_struct({keyed}, 'points', array({', '.join(points)}))" for keyed, points in by_labels.items()]
        events = in_range(self.table("events"), "ts", start, end).selectExpr("*", f"{_K} AS k")
        labelled = events.selectExpr(
            "ts", "event_id", "user_id", "value", "k", *[f"{text} AS {column}" for text, column in texts.items()]
        )
        return labelled.selectExpr("ts", f"inline(array({', '.join(sets)}))").selectExpr(
            "ts", "labels", "series", "inline(points)"
        ).select("ts", "metric", "labels", "series", "value")

    def raw_speed(self, start=None, end=None) -> DataFrame:
        """Raw speed records as the JSON feed has them: times as text, some speeds unusable."""
        t = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        plain = F.col("event_type") != "error"
        return (
            self.raw(start, end)
            .where(F.col("event_type") != "view")
            .select(
                *KEYS,
                F.when(plain, t).alias("time"),
                F.when(~plain, t).alias("timestamp"),
                F.expr("CASE WHEN k % 17 = 0 THEN 'n/a' ELSE CAST(k * 0.5D AS STRING) END").alias("speed"),
            )
        )

    def raw_frames(self, start=None, end=None) -> DataFrame:
        key = F.concat(F.lit("raw/images/"), F.col("event_id").cast("string"), F.lit(".jpg"))
        return (
            self.raw(start, end)
            .where(F.col("event_type").isin("view", "click"))
            .select(
                *KEYS,
                F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("time"),
                F.lit(None).cast("string").alias("timestamp"),
                F.when(F.col("event_type") == "view", F.concat(F.lit("s3://traffic-data/"), key)).alias("image_ref"),
                F.when(F.col("event_type") == "click", key).alias("image_key"),
            )
        )

    def raw_weather(self, start=None, end=None) -> DataFrame:
        """Raw weather documents with the time they were stored, ``ts``."""
        typed = lambda doc: F.from_json(doc, schemas.WEATHER_DOC)
        doc = F.to_json(F.struct(
            F.array(F.struct(
                (F.col("k") + 500).alias("id"), F.expr(_MAIN).alias("main"),
                F.lit("as sent").alias("description"), F.lit("10d").alias("icon"),
            )).alias("weather"),
            F.struct(F.expr("20 + k % 17").alias("temp"), F.expr("50 + k % 46").alias("humidity")).alias("main"),
            F.struct(F.expr("k % 19 * 0.5D").alias("speed"), (F.col("k") * 3).alias("deg")).alias("wind"),
            F.struct(F.col("k").alias("all")).alias("clouds"),
        ))
        return self.raw(start, end).where(F.col("event_type") == "signup").select(*KEYS, "ts", typed(doc).alias("doc")).select(
            *KEYS, "ts", "doc.*"
        )
