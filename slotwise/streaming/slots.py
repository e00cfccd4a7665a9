"""Slots from streams of raw records.

State holds only fixed-size aggregates per open (camera, slot). The samples themselves
are appended in long form and packed into arrays by the batch job once a slot is closed,
so no state row grows with a busy camera.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from slotwise import schemas
from slotwise.functions import cleaning as clean
from slotwise.functions.timekeys import HTTP_DATE, as_utc, to_local
from slotwise.operators.slots import completeness

SLOT = "5 minutes"
LATENESS = "5 minutes"

# The topics of the three feeds and of the monitoring samples.
TOPICS = {"frame": "traffic-images", "speed": "traffic-speed", "weather": "traffic-weather", "metrics": "metrics"}


def kafka_records(spark: SparkSession, servers: str, topic: str, schema: T.StructType, per_trigger: int | None = None) -> DataFrame:
    """JSON messages of a topic as rows, with the broker's timestamp as ``ts``."""
    stream = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    if per_trigger:
        stream = stream.option("maxOffsetsPerTrigger", per_trigger)
    return decode(stream.load(), schema)


def decode(messages: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows of ``value`` (JSON) and ``timestamp``; unreadable messages become rows of NULLs."""
    parsed = F.from_json(F.col("value").cast("string"), schema)
    return messages.select(F.col("timestamp").alias("ts"), parsed.alias("_r")).select("ts", "_r.*")


def file_records(spark: SparkSession, path: str, schema: T.StructType, file_format: str = "json", per_trigger: int | None = None) -> DataFrame:
    """New files under a folder as a stream."""
    reader = spark.readStream.schema(schema).format(file_format)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.load(path)


def feed(records: DataFrame, kind: str, speed: Column | None = None, doc: Column | None = None) -> DataFrame:
    """One feed in the common shape: camera_id, ts, kind, speed, doc."""
    none_doc = F.lit(None).cast(schemas.WEATHER_DOC)
    return records.where(clean.has_camera(F.col("camera_id"))).select(
        "camera_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.lit(kind).alias("kind"),
        (F.lit(None).cast("double") if speed is None else speed).alias("speed"),
        (none_doc if doc is None else doc).alias("doc"),
    )


def _wall_clock(instant: str, local: bool = False) -> Column:
    """An instant as UTC or local wall-clock time, whatever the session's zone."""
    utc = as_utc(F.col(instant))
    return to_local(utc) if local else utc


def event_time(records: DataFrame, header: Column) -> DataFrame:
    """``ts`` as the instant that the source's HTTP ``Date`` header names; unreadable headers
    leave the time of arrival."""
    named = F.try_to_timestamp(F.substring(F.trim(header), 6, 64), F.lit(HTTP_DATE))
    return records.withColumn("ts", F.coalesce(named, F.col("ts").cast("timestamp")))


def stream_speed_slots(samples: DataFrame, lateness: str = LATENESS, local: bool = True) -> DataFrame:
    """Speed statistics of closed slots. ``ts`` must be an instant (TIMESTAMP).

    ``slot`` is the label in the object keys: local wall-clock time, in any session zone;
    UTC with ``local`` off.
    """
    return (
        samples.withWatermark("ts", lateness)
        .groupBy(F.window("ts", SLOT), "camera_id")
        .agg(
            F.count("speed").cast("int").alias("speed_count"),
            F.avg("speed").alias("speed_avg_kmh"),
            F.min("speed").alias("speed_min_kmh"),
            F.max("speed").alias("speed_max_kmh"),
        )
        .select("camera_id", _wall_clock("window.start", local).alias("slot"), "speed_count", "speed_avg_kmh", "speed_min_kmh", "speed_max_kmh")
    )


def stream_slot_rows(feeds: DataFrame, lateness: str = LATENESS, local: bool = True) -> DataFrame:
    """The three stacked feeds as one row per closed slot; the last weather document wins.

    One windowed aggregation: no stream-stream join, so no buffered rows. ``local`` as in
    :func:`stream_speed_slots`.
    """
    is_kind = lambda kind: F.when(F.col("kind") == kind, 1)
    merged = (
        feeds.withWatermark("ts", lateness)
        .groupBy(F.window("ts", SLOT), "camera_id")
        .agg(
            F.count(is_kind("frame")).cast("int").alias("frame_count"),
            F.count("speed").cast("int").alias("speed_count"),
            F.avg("speed").alias("speed_avg_kmh"),
            F.min("speed").alias("speed_min_kmh"),
            F.max("speed").alias("speed_max_kmh"),
            # Of documents of one instant the largest as text, so that a re-run agrees.
            F.max_by("doc", F.when(F.col("doc").isNotNull(), F.struct("ts", F.to_json("doc")))).alias("_doc"),
        )
    )
    return merged.select(
        "camera_id",
        _wall_clock("window.start", local).alias("slot"),
        _wall_clock("window.end", local).alias("generated_at"),
        F.lit(300).alias("duration_sec"),
        "frame_count", "speed_count", "speed_avg_kmh", "speed_min_kmh", "speed_max_kmh",
        clean.flat_weather(F.col("_doc")).alias("weather"),
        completeness(F.col("frame_count") > 0, F.col("speed_count") > 0, F.col("_doc").isNotNull()).alias("completeness"),
    )


def stream_rate(samples: DataFrame, window: str = "10 minutes", slide: str = "15 seconds", lateness: str = LATENESS) -> DataFrame:
    """Counter increase per second over sliding windows of each ``series``.

    Samples are first reduced to panes of one slide: first and last value, and the increase
    from sample to sample, where a drop is a restart from 0. A window then adds its panes'
    increases and the steps between them, so any number of restarts is counted, and a
    window's state is one small row per pane, not per sample. A pane's own state, until the
    watermark closes it, is its samples: late ones may still come between them.
    """
    step = lambda before, after: F.when(after >= before, after - before).otherwise(after)
    panes = (
        samples.withWatermark("ts", lateness)
        .groupBy(F.window("ts", slide).alias("pane"), "metric", "series")
        .agg(F.array_sort(F.collect_list(F.struct("ts", "value"))).alias("_s"))
    )
    values = F.transform("_s", lambda s: s["value"])
    panes = panes.select("pane", "metric", "series", values.alias("_v")).select(
        "pane", "metric", "series",
        F.struct(
            F.col("pane.start").alias("at"), F.size("_v").alias("n"), F.get("_v", F.lit(0)).alias("first"),
            F.element_at("_v", -1).alias("last"), _increase(F.col("_v"), lambda x: x, lambda x: x, lambda x: F.lit(0.0), step).alias("rise"),
        ).alias("_p"),
    )
    seconds = (F.unix_micros("window.end") - F.unix_micros("window.start")) / 1_000_000
    rise = _increase(F.col("_ps"), lambda p: p["first"], lambda p: p["last"], lambda p: p["rise"], step)
    return (
        panes.groupBy(F.window("pane", window, slide), "metric", "series")
        .agg(F.array_sort(F.collect_list("_p")).alias("_ps"))
        .withColumn("samples", F.aggregate("_ps", F.lit(0), lambda n, p: n + p["n"]).cast("long"))
        .where(F.col("samples") >= 2)
        .select(
            _wall_clock("window.start").alias("window_start"), _wall_clock("window.end").alias("window_end"),
            "metric", "series", "samples", (rise / seconds).alias("rate"),
        )
    )


def _increase(items: Column, first, last, rise, step) -> Column:
    """The items' own increases and the steps from each to the next."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("before"))
    return F.aggregate(
        items, start,
        lambda acc, x: F.struct(
            (acc["sum"] + rise(x) + F.when(acc["before"].isNull(), 0.0).otherwise(step(acc["before"], first(x)))).alias("sum"),
            last(x).alias("before"),
        ),
        lambda acc: acc["sum"],
    )


def append_days(rows: DataFrame, path: str, checkpoint: str, time_column: str = "slot", once: bool = False) -> StreamingQuery:
    """Append to Parquet, one folder per day; exactly once through the file sink's log."""
    writer = (
        rows.withColumn("dt", F.to_date(time_column))
        .writeStream.outputMode("append")
        .format("parquet")
        .partitionBy("dt")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if once else writer).start()


def split_rejects(records: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Records with a camera id under ``accepted``, the others under ``rejected``.

    Each batch overwrites its own folder, so a batch that runs again writes the same rows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("route", F.when(clean.has_camera(F.col("camera_id")), "accepted").otherwise("rejected")).withColumn(
            "batch", F.lit(batch_id)
        ).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("route", "batch").parquet(path)

    return _each_batch(records, write, checkpoint, once)


#: Batches after which the changes may be folded into the base, at least.
FOLD_BATCHES = 8


def keep_latest(records: DataFrame, path: str, checkpoint: str, once: bool = False, fold_batches: int = FOLD_BATCHES) -> StreamingQuery:
    """The last record per camera, as a base and changes; read it with :func:`read_latest`.

    A batch writes its own newest record per camera to ``changes/batch=<id>``, and no more:
    what is written follows the batch. When the changes since the base are as large as the
    base, and ``fold_batches`` or more, they are folded into the next base, so folding
    writes no more than the batches did. What the base before it covers is then removed.
    A batch that runs again overwrites its change and its base with the same rows.
    """
    columns = records.columns

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        last_per_camera(batch).select(*columns).write.mode("overwrite").parquet(f"{path}/changes/batch={batch_id}")
        base, changes = _state(spark, path, batch_id)
        size = sum(_bytes(spark, f"{path}/changes/batch={n}") for n in changes)
        if len(changes) < fold_batches or (base is not None and size < _bytes(spark, f"{path}/base/batch={base}")):
            return
        merged = last_per_camera(_state_rows(spark, path, batch.schema, base, changes))
        merged.select(*columns).write.mode("overwrite").parquet(f"{path}/base/batch={batch_id}")
        # The base before stays, with the changes after it, for readers that have begun and
        # for this batch, should it run again.
        old = -1 if base is None else base
        for kind, limit in (("base", old), ("changes", old + 1)):
            for n in _finished(spark, f"{path}/{kind}"):
                if n < limit:
                    files, folder = _folder(spark, f"{path}/{kind}/batch={n}")
                    files.delete(folder, True)

    return _each_batch(records, write, checkpoint, once)


def last_per_camera(records: DataFrame) -> DataFrame:
    """The newest record per camera; of several at its instant the largest, column by column."""
    newest = F.struct("ts", F.struct(*records.columns))
    return records.groupBy("camera_id").agg(F.max_by(F.struct(*records.columns), newest).alias("_r")).select("_r.*")


def read_latest(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What :func:`keep_latest` holds: the newest base and the changes after it, merged."""
    base, changes = _state(spark, path, None)
    if base is None and not changes:
        return spark.createDataFrame([], schema)
    return last_per_camera(_state_rows(spark, path, schema, base, changes)).select(*schema.fieldNames())


def _state(spark: SparkSession, path: str, upto: int | None) -> tuple[int | None, list[int]]:
    """The newest base before batch ``upto``, and the changes after it up to that batch."""
    bases = [n for n in _finished(spark, f"{path}/base") if upto is None or n < upto]
    base = max(bases, default=None)
    changes = _finished(spark, f"{path}/changes")
    return base, [n for n in changes if (base is None or n > base) and (upto is None or n <= upto)]


def _state_rows(spark: SparkSession, path: str, schema: T.StructType, base: int | None, changes: list[int]) -> DataFrame:
    folders = [f"{path}/changes/batch={n}" for n in changes] + ([] if base is None else [f"{path}/base/batch={base}"])
    return spark.read.schema(schema).parquet(*folders)


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def _bytes(spark: SparkSession, path: str) -> int:
    files, folder = _folder(spark, path)
    return files.getContentSummary(folder).getLength()


def _finished(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the finished batches under a folder: since the last fold, not all."""
    files, root = _folder(spark, path)
    if not files.exists(root):
        return []
    numbers = []
    for status in files.listStatus(root):
        folder = status.getPath()
        if folder.getName().startswith("batch=") and files.exists(spark._jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS")):
            numbers.append(int(folder.getName().split("=")[1]))
    return sorted(numbers)


def _each_batch(records: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, once: bool) -> StreamingQuery:
    writer = records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
