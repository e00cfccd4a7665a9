"""Streaming jobs by name: each drains the driver's events once and gives what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise import schemas
from slotwise.functions import cleaning as clean
from slotwise.operators import late
from slotwise.operators import slots as batch
from slotwise.registry.base import BUCKET, register
from slotwise.session import fresh_dir
from slotwise.sources.driver_tables import DriverTables
from slotwise.streaming import folded
from slotwise.streaming import slots as stream


class StreamedTables(DriverTables):
    """The driver's tables with ``events`` read as a stream of files."""

    def table(self, name: str) -> DataFrame:
        path = f"{self.sf_dir}/{name}.parquet"
        if name != "events":
            return super().table(name)
        # A glob, as a stream takes no single file; it also matches a folder of files.
        return stream.file_records(self.spark, path[:-1] + "[t]", self.schema(name), "parquet")


def streamed(src) -> StreamedTables:
    return StreamedTables(src.spark, src.sf_dir)


def _drain(src, rows: DataFrame, time_column: str = "slot") -> DataFrame:
    """Run the stream over what is there now and read back what the sink committed."""
    root = fresh_dir(src.spark, "stream")
    query = stream.append_days(rows, f"{root}/out", f"{root}/checkpoint", time_column, once=True)
    query.awaitTermination()
    return src.spark.read.schema(rows.schema).parquet(f"{root}/out").drop("dt")


def _speed_feed(live) -> DataFrame:
    """Usable samples with the instant they were taken at."""
    raw = live.raw().where(F.col("event_type") != "view")
    speed = clean.speed_value(F.expr("CASE WHEN k % 17 = 0 THEN 'n/a' ELSE CAST(k * 0.5D AS STRING) END"))
    return stream.feed(raw.withColumn("_speed", speed).where(F.col("_speed").isNotNull()), "speed", F.col("_speed"))


def _frame_feed(live) -> DataFrame:
    return stream.feed(live.raw().where(F.col("event_type").isin("view", "click")), "frame")


def _weather_feed(live) -> DataFrame:
    return stream.feed(live.raw_weather(), "weather", doc=F.struct(*schemas.WEATHER_DOC.fieldNames()))


def _stream_slots(src):
    return _drain(src, stream.stream_speed_slots(_speed_feed(streamed(src))))


def _stream_merge(src):
    live = streamed(src)
    feeds = _frame_feed(live).unionByName(_speed_feed(live)).unionByName(_weather_feed(live))
    return _drain(src, stream.stream_slot_rows(feeds))


def _merged_columns(rows: DataFrame) -> DataFrame:
    return rows.select(
        "camera_id", "slot", "generated_at", "frame_count", "speed_count", "speed_avg_kmh", "speed_min_kmh", "speed_max_kmh",
        F.col("weather.id").alias("weather_id"), F.col("weather.temp").alias("weather_temp"), "completeness")


register("stream_slots", _stream_slots)
register("stream_merge", lambda src: _merged_columns(_stream_merge(src)), 6)
register("stream_close", lambda src: _stream_merge(src).select("camera_id", "slot", "completeness"))


def _stream_sink(src):
    """Closed slots by day, counted per day folder."""
    return _drain(src, stream.stream_speed_slots(_speed_feed(streamed(src)))).groupBy(
        F.to_date("slot").alias("dt")).agg(F.count(F.lit(1)).alias("slots"), F.sum("speed_count").alias("samples"))


register("stream_sink", _stream_sink)


def _stream_folded(src):
    """Every sample, appended by a stream that folds its runs, counted per day."""
    samples = _speed_feed(streamed(src)).select("camera_id", F.col("ts").cast("timestamp_ntz").alias("slot"), "speed")
    root = fresh_dir(src.spark, "stream")
    folded.append_folded(samples, f"{root}/out", f"{root}/checkpoint", once=True).awaitTermination()
    return folded.read_folded(src.spark, f"{root}/out", samples.schema).groupBy("dt").agg(
        F.count(F.lit(1)).alias("samples"), F.sum("speed").alias("speeds"))


register("stream_folded", _stream_folded)


def _stream_late(src):
    """What a stream that never saw every eleventh sample is missing in its closed slots."""
    samples = _speed_feed(streamed(src))
    streamed_slots = _drain(src, stream.stream_speed_slots(samples.where((F.col("speed") * 2).cast("long") % 11 != 0)))
    found = late.late_slots(stream.stream_speed_slots(_speed_feed(src)), streamed_slots)
    return found.select("camera_id", "slot", "speed_count", F.col("late_samples").cast("long").alias("late_samples"), "missed")


register("stream_late", _stream_late)


def _stream_last_wins(src):
    """The newest image reference per camera."""
    live = streamed(src)
    key = F.concat(F.lit(f"s3://{BUCKET}/raw/images/"), F.col("event_id").cast("string"), F.lit(".jpg"))
    frames = live.raw().where(F.col("event_type").isin("view", "click")).select("camera_id", "ts", key.alias("image_ref"))
    root = fresh_dir(src.spark, "stream")
    stream.keep_latest(frames, f"{root}/out", f"{root}/checkpoint", once=True).awaitTermination()
    return stream.read_latest(src.spark, f"{root}/out", frames.schema)


register("stream_last_wins", _stream_last_wins)


def _stream_reject(src):
    kind = F.col("event_type")
    given = F.when(kind == "error", F.lit("  ")).when(kind != "signup", F.col("camera_id"))
    records = streamed(src).raw().select("event_id", given.alias("camera_id"))
    root = fresh_dir(src.spark, "stream")
    stream.split_rejects(records, f"{root}/out", f"{root}/checkpoint", once=True).awaitTermination()
    return src.spark.read.parquet(f"{root}/out").select("event_id", "camera_id", F.col("route").cast("string").alias("route"))


register("stream_reject", _stream_reject)


def _stream_rate(src):
    live = streamed(src)
    samples = live.metrics(["nifi_amount_flowfiles_received"]).select(
        F.col("ts").cast("timestamp").alias("ts"), "metric", "series", "value")
    return _drain(src, stream.stream_rate(samples), "window_start")


register("stream_rate", _stream_rate, 6)


def _stream_source(src):
    """Messages as a broker gives them, JSON in ``value``, decoded and appended."""
    live = streamed(src)
    messages = live.raw_speed().select(
        F.col("slot").cast("timestamp").alias("timestamp"),
        F.to_json(F.struct("camera_id", "time", "timestamp", "speed")).cast("binary").alias("value"))
    records = stream.decode(messages, schemas.RAW_SPEED).withColumn("slot", F.col("ts").cast("timestamp_ntz")).drop("ts")
    return _drain(src, batch.clean_speed(records))


register("stream_source", _stream_source)
