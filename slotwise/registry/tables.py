"""Slot aggregation, sources and sinks by name.

The storage queries write what they read to a new folder under the shared root.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise import schemas
from slotwise.functions.cleaning import flat_weather
from slotwise.operators import slots
from slotwise.operators.joins import join_predicts
from slotwise.plans import ingest
from slotwise.registry.base import AS_OF, BUCKET, register
from slotwise.session import fresh_dir
from slotwise.sources import json_feed, sinks
from slotwise.sources.bucketed import BucketedTables
from slotwise.sources.tables import StoredTables

KEY = ["camera_id", "slot"]


def _feeds(src) -> tuple[DataFrame, DataFrame, DataFrame]:
    frames = slots.clean_frames(src.raw_frames(), BUCKET)
    samples = slots.clean_speed(src.raw_speed())
    return frames, samples, slots.latest_weather(src.raw_weather(), "ts")


def _documents(src) -> DataFrame:
    return slots.slot_documents(*_feeds(src))


register("slot_union_join", lambda src: slots.slot_parts(*_feeds(src)).withColumn(
    "weather_temp", F.col("weather.main.temp")).drop("weather"))
register("slot_speed_stats", lambda src: slots.slot_speed_stats(slots.clean_speed(src.raw_speed())))


def _series(src):
    samples = slots.clean_speed(src.raw_speed())
    series = slots.pack(samples, "series", ["time", "speed"])
    return series.select(
        *KEY,
        F.array_join(F.transform("series", lambda s: s["time"]), " | ").alias("times"),
        F.aggregate("series", F.lit(0.0), lambda total, s: total * 2 + s["speed"]).alias("ordered_sum"),
    )


register("slot_series", _series)
register("slot_completeness", lambda src: slots.slot_parts(*_feeds(src)).select(*KEY, "completeness"))
register("slot_frame_count", lambda src: slots.slot_parts(*_feeds(src)).select(*KEY, "frame_count"))


def _document_columns(documents: DataFrame) -> DataFrame:
    return documents.select(
        "camera_id", "slot", "generated_at", "duration_sec",
        F.array_join(F.transform("frames", lambda f: F.concat(f["time"], F.lit(" "), f["image_ref"])), " | ").alias("frames"),
        F.col("speed.count").alias("speed_count"),
        F.col("speed.avg_kmh").alias("speed_avg_kmh"),
        F.col("speed.min_kmh").alias("speed_min_kmh"),
        F.col("speed.max_kmh").alias("speed_max_kmh"),
        F.array_join(F.transform("speed.series", lambda s: s["time"]), " | ").alias("series_times"),
        F.col("weather.main.temp").alias("weather_temp"),
        F.get("weather.weather", F.lit(0))["id"].alias("weather_id"),
        "frame_count", "completeness",
    )


register("slot_document", lambda src: _document_columns(_documents(src)), 6)


WEATHER_FIELDS = ("id", "main", "temp", "humidity", "wind_speed", "wind_deg", "clouds_all", "pressure")


def _event_columns(events: DataFrame, *more: str) -> DataFrame:
    return events.select(
        *KEY, "generated_at", "duration_sec", "vehicles_count", "speed_count", "speed_avg_kmh", "speed_min_kmh",
        "speed_max_kmh", F.coalesce(F.get("speed_series", F.size("speed_series") - 1)["time"]).alias("last_time"),
        *[F.col(f"weather.{f}").alias(f"weather_{f}") for f in WEATHER_FIELDS], *more,
    )


register("batch_to_events", lambda src: _event_columns(slots.flatten_documents(_documents(src))), 6)
register("flatten_slot", lambda src: slots.flatten_documents(_documents(src)).select(
    *KEY, "speed_count", "speed_avg_kmh", F.col("weather.id").alias("weather_id"),
    F.col("weather.main").alias("weather_main"), F.col("weather.wind_speed").alias("wind_speed")), 6)


def _defaults(src):
    """Documents of which some lack a vehicle count."""
    counted = src.events().select(
        "camera_id", F.date_format("slot", "yyyy-MM-dd HH:mm:ss").alias("slot"),
        F.when(F.col("weather.main") != "Rain", F.col("vehicles_count")).alias("vehicles_count"))
    documents = _documents(src).join(counted, KEY)
    return slots.flatten_documents(documents).select(*KEY, "vehicles_count", "speed_count", F.col("weather.main").alias("weather_main"))


register("default_fields", _defaults)


# Stored tables

EARLY, LATE = datetime(2024, 1, 3, 6, 0, 0), datetime(2024, 1, 28, 18, 0, 0)
PLAIN = [*KEY, "vehicles_count", "speed_avg_kmh"]


def stored(src) -> StoredTables:
    return StoredTables(src.spark, fresh_dir(src.spark, "tables"))


def _src_events(src):
    tables = stored(src)
    sinks.write_events(src.events(), tables.root)
    return tables.events(EARLY, LATE).select(*PLAIN, F.col("weather.main").alias("weather_main"))


def _src_cameras(src):
    tables = stored(src)
    sinks.write_cameras(src.cameras(), tables.root)
    return tables.cameras()


def _predict_columns(predicts: DataFrame) -> DataFrame:
    return predicts.select(
        *KEY, F.size("count_preds").alias("steps"), F.element_at("count_preds", 1).alias("count_t1"),
        F.element_at("avg_kmh_preds", -1).alias("speed_t12"))


def _src_predicts(src):
    tables = stored(src)
    sinks.write_predicts(src.predicts(), tables.root)
    return _predict_columns(tables.predicts())


def _sink_events(src):
    """Written twice: a re-run of the same days replaces them."""
    tables = stored(src)
    for start, end in ((None, None), (EARLY.replace(hour=0), LATE.replace(hour=0))):
        sinks.write_events(src.events(start, end), tables.root)
        sinks.write_samples(src.samples(start, end), tables.root)
    written = tables.events(series=True)
    return written.select(*PLAIN, F.coalesce(F.size("speed_series"), F.lit(0)).alias("samples"))


def _sink_predicts(src):
    tables = stored(src)
    sinks.write_predicts(src.predicts(), tables.root)
    return _predict_columns(tables.predicts())


def _src_metrics(src):
    tables = stored(src)
    sinks.write_metrics(src.metrics(), tables.root)
    return tables.metrics().groupBy("metric", "series").agg(
        F.count("value").alias("samples"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.min("value").alias("least"), F.max("value").alias("most"))


register("src_events", _src_events)
register("src_cameras", _src_cameras, 6)
register("src_predicts", _src_predicts)
register("sink_events", _sink_events)
register("sink_predicts", _sink_predicts)
register("src_metrics", _src_metrics)


def _join_bucketed(src):
    """Slots and forecasts joined bucket by bucket."""
    tables = BucketedTables(src.spark, fresh_dir(src.spark, "tables"), 4)
    tables.write("events", src.events())
    tables.write("predicts", src.predicts())
    return join_predicts(tables.events(), tables.predicts()).select(*PLAIN, F.element_at("count_preds", 1).alias("count_t1"))


register("join_predict_bucketed", _join_bucketed)


# JSON


def _sink_slot_json(src):
    path = fresh_dir(src.spark, "slot-json")
    documents = _documents(src)
    sinks.write_slot_documents(documents, path)
    back = src.spark.read.schema(documents.schema).json(path)
    return _document_columns(back)


register("sink_slot_json", _sink_slot_json, 6)


def _raw_speed_text(src) -> DataFrame:
    return src.raw_speed().withColumn("slot", F.date_format("slot", "yyyy-MM-dd'T'HH:mm:ss"))


def _src_json_load(src):
    path = fresh_dir(src.spark, "raw-json")
    json_feed.write_json_arrays(_raw_speed_text(src), path)
    return slots.clean_speed(json_feed.read_json(src.spark, path, schemas.RAW_SPEED, "part-*"))


def _src_json_merge(src):
    """Frames and speeds under one prefix, told apart by the fields they have."""
    path = fresh_dir(src.spark, "raw-json")
    json_feed.write_json_arrays(_raw_speed_text(src), f"{path}/speed")
    frames = src.raw_frames().withColumn("slot", F.date_format("slot", "yyyy-MM-dd'T'HH:mm:ss"))
    json_feed.write_json_arrays(frames, f"{path}/manifest")
    both = schemas.T.StructType([*schemas.RAW_SPEED.fields, *schemas.RAW_FRAME.fields[-2:]])
    records = json_feed.read_json(src.spark, path, both, "part-*")
    return records.groupBy("camera_id").agg(
        F.count("speed").alias("speeds"), F.count(F.coalesce("image_ref", "image_key")).alias("frames"))


def _write_weather(src, path: str) -> None:
    documents = src.raw_weather().withColumns({
        "slot": F.date_format("slot", "yyyy-MM-dd'T'HH:mm:ss"), "stored_at": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
    }).drop("ts")
    json_feed.write_json_arrays(documents, path)


def _src_json_weather(src):
    """Weather documents as objects hold them, flattened."""
    path = fresh_dir(src.spark, "raw-json")
    _write_weather(src, path)
    records = json_feed.read_json(src.spark, path, schemas.STORED_WEATHER, "part-*")
    flat = flat_weather(F.struct(*schemas.WEATHER_DOC.fieldNames()))
    return records.select("camera_id", "slot", "stored_at", flat.alias("w")).select(
        "camera_id", "slot", "stored_at", *[F.col(f"w.{f}").alias(f"weather_{f}") for f in WEATHER_FIELDS])


def _ingest_batch(src):
    """Raw objects of three feeds to stored tables: all days at once, then one day again slot by slot."""
    path, tables = fresh_dir(src.spark, "raw-json"), stored(src)
    json_feed.write_json_arrays(_raw_speed_text(src), f"{path}/speed")
    frames = src.raw_frames().withColumn("slot", F.date_format("slot", "yyyy-MM-dd'T'HH:mm:ss"))
    json_feed.write_json_arrays(frames, f"{path}/manifest")
    _write_weather(src, f"{path}/weather")
    ingest.ingest(tables, path, BUCKET, AS_OF, "part-*")
    ingest.ingest(tables, path, BUCKET, EARLY, "part-*", whole_days=False)
    per_slot = tables.frames().groupBy(*KEY).agg(F.count(F.lit(1)).alias("frame_count"))
    events = tables.events(series=True).join(per_slot, KEY, "left").withColumn("frame_count", F.coalesce("frame_count", F.lit(0)).cast("int"))
    return _event_columns(events, "frame_count")


def _src_json_list(src):
    """The day files of the slot documents; their number per day depends on the cluster."""
    path = fresh_dir(src.spark, "slot-json")
    sinks.write_slot_documents(_documents(src), path)
    listed = json_feed.list_json(src.spark, path)
    return listed.groupBy(F.regexp_extract("path", r"dt=([0-9-]+)", 1).alias("dt")).agg(
        (F.sum("length") > 0).alias("has_content")).orderBy("dt")


def _src_json_new(src):
    """The same files, noted as they come: the second look finds nothing new."""
    path, index = fresh_dir(src.spark, "slot-json"), fresh_dir(src.spark, "json-index")
    sinks.write_slot_documents(_documents(src), path)
    for _ in range(2):
        json_feed.note_new(src.spark, path, index).awaitTermination()
    return json_feed.noted(src.spark, index).groupBy(F.regexp_extract("path", r"dt=([0-9-]+)", 1).alias("dt")).agg(
        (F.sum("length") > 0).alias("has_content"), (F.count("path") == F.count_distinct("path")).alias("once"))


register("src_json_load", _src_json_load)
register("src_json_merge", _src_json_merge)
register("src_json_list", _src_json_list)
register("src_json_new", _src_json_new)
register("src_json_weather", _src_json_weather)
register("ingest_batch", _ingest_batch, 6)
