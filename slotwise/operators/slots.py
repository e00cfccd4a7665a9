"""Raw records to slot rows: statistics, series, documents, flat events.

Statistics merge in the shuffle's map side, so a camera or slot holding a large share
of all records costs one partial row per task. Only documents with arrays gather the
records of a slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.functions import cleaning as clean
from slotwise.functions.numeric import rounded
from slotwise.functions.timekeys import SLOT_SECONDS

KEYS = ["camera_id", "slot"]

def clean_speed(raw: DataFrame) -> DataFrame:
    """Usable samples: camera_id, slot, time (text), speed."""
    return (
        raw.where(clean.has_camera(F.col("camera_id")))
        .select(
            *KEYS,
            clean.speed_time(F.col("time"), F.col("timestamp")).alias("time"),
            clean.speed_value(F.col("speed")).alias("speed"),
        )
        .where(F.col("time").isNotNull() & F.col("speed").isNotNull())
    )


def clean_frames(raw: DataFrame, bucket: str) -> DataFrame:
    """Usable frames: camera_id, slot, time (text), image_ref."""
    return (
        raw.where(clean.has_camera(F.col("camera_id")))
        .select(
            *KEYS,
            clean.record_time(F.col("time"), F.col("timestamp")).alias("time"),
            clean.frame_ref(F.col("image_ref"), F.col("image_key"), bucket).alias("image_ref"),
        )
        .where(F.col("time").isNotNull() & F.col("image_ref").isNotNull())
    )


def rejected(raw: DataFrame) -> DataFrame:
    """Records without a usable camera id: the side that goes to the failure route."""
    return raw.where(~clean.has_camera(F.col("camera_id")))


def slot_speed_stats(samples: DataFrame) -> DataFrame:
    """Count, mean, min and max speed per slot; ``avg_kmh_1`` is the one-decimal form."""
    return (
        samples.groupBy(*KEYS)
        .agg(
            F.count("speed").cast("int").alias("count"),
            F.avg("speed").alias("avg_kmh"),
            F.min("speed").alias("min_kmh"),
            F.max("speed").alias("max_kmh"),
        )
        .withColumn("avg_kmh_1", rounded(F.col("avg_kmh")))
    )


def pack(records: DataFrame, name: str, fields: list[str]) -> DataFrame:
    """Per slot, its records as a time-ordered array of structs, whatever their number.

    Nothing here stores this form: records are kept long, and an array is built when a
    caller asks for one.
    """
    return records.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))


def latest_weather(raw: DataFrame, order: str) -> DataFrame:
    """The last weather document per slot: later objects overwrite earlier ones."""
    payload = [c for c in raw.columns if c not in (*KEYS, order)]
    # Of documents of the same instant the largest as text is kept, so that a re-run agrees.
    last = F.struct(F.col(order), F.to_json(F.struct(*payload)))
    return raw.groupBy(*KEYS).agg(F.max_by(F.struct(*payload), last).alias("weather"))


def completeness(*parts: Column) -> Column:
    """Share of the parts that are present, as a truncated percentage."""
    present = sum((F.coalesce(part, F.lit(False)).cast("int") for part in parts), F.lit(0))
    return F.floor(present * 100 / len(parts)).cast("int")


def slot_parts(frames: DataFrame, samples: DataFrame, weather: DataFrame, arrays: bool = False) -> DataFrame:
    """One row per slot that any feed mentions, with what each feed contributed.

    Frames and samples are stacked and grouped once; without ``arrays`` only numbers are
    aggregated, so the grouping stays a hash aggregate. ``weather`` is one row per slot
    (:func:`latest_weather`) and is grouped by the same keys, so joining it needs no further
    shuffle. ``arrays`` adds ``frame_list`` and ``series``, time-ordered.
    """
    frame = F.struct("time", "image_ref") if arrays else F.lit(1)
    sample = F.struct("time", "speed") if arrays else F.lit(1)
    stacked = frames.select(*KEYS, frame.alias("frame")).unionByName(
        samples.select(*KEYS, "speed", sample.alias("sample")), allowMissingColumns=True
    )
    lists = [
        F.array_sort(F.collect_list("frame")).alias("frame_list"),
        F.array_sort(F.collect_list("sample")).alias("series"),
    ]
    counted = stacked.groupBy(*KEYS).agg(
        F.count("frame").cast("int").alias("frame_count"),
        F.count("speed").cast("int").alias("speed_count"),
        F.avg("speed").alias("speed_avg_kmh"),
        F.min("speed").alias("speed_min_kmh"),
        F.max("speed").alias("speed_max_kmh"),
        *(lists if arrays else []),
    )
    merged = counted.join(weather.select(*KEYS, "weather"), KEYS, "full").withColumns({
        "frame_count": F.coalesce("frame_count", F.lit(0)),
        "speed_count": F.coalesce("speed_count", F.lit(0)),
    })
    return merged.withColumn(
        "completeness",
        completeness(F.col("frame_count") > 0, F.col("speed_count") > 0, F.col("weather").isNotNull()),
    )


def slot_documents(frames: DataFrame, samples: DataFrame, weather: DataFrame, arrays: bool = True) -> DataFrame:
    """The nested document of every (camera, slot) at once.

    ``slot`` is a timestamp here; ``speed`` is NULL for a slot without samples. Without
    ``arrays`` the two lists are NULL and no record is gathered.
    """
    parts = slot_parts(frames, samples, weather, arrays)
    text = "yyyy-MM-dd HH:mm:ss"
    none_frames = F.lit(None).cast("array<struct<time:string,image_ref:string>>")
    none_series = F.lit(None).cast("array<struct<time:string,speed:double>>")
    frame_list = F.coalesce("frame_list", F.array().cast("array<struct<time:string,image_ref:string>>")) if arrays else none_frames
    return parts.select(
        "camera_id",
        F.date_format("slot", text).alias("slot"),
        F.date_format(F.col("slot") + F.expr(f"INTERVAL {SLOT_SECONDS} SECONDS"), text).alias("generated_at"),
        F.lit(SLOT_SECONDS).alias("duration_sec"),
        frame_list.alias("frames"),
        F.when(
            F.col("speed_count") > 0,
            F.struct(
                F.col("speed_count").alias("count"),
                F.col("speed_avg_kmh").alias("avg_kmh"),
                F.col("speed_min_kmh").alias("min_kmh"),
                F.col("speed_max_kmh").alias("max_kmh"),
                (F.col("series") if arrays else none_series).alias("series"),
            ),
        ).alias("speed"),
        "weather",
        "frame_count",
        "completeness",
    )


def flatten_documents(documents: DataFrame) -> DataFrame:
    """Slot documents as rows of the events table.

    Frames are dropped, absent measures stay NULL, and a missing vehicle count becomes 0
    (it comes from image detection, which may not have run).
    """
    counted = "vehicles_count" in documents.columns
    vehicles = F.coalesce(F.col("vehicles_count"), F.lit(0.0)) if counted else F.lit(0.0)
    series = F.transform(
        "speed.series",
        lambda s: F.struct(s["time"].try_cast("timestamp_ntz").alias("time"), s["speed"].alias("speed")),
    )
    return documents.select(
        "camera_id",
        F.col("slot").try_cast("timestamp_ntz").alias("slot"),
        F.col("generated_at").try_cast("timestamp_ntz").alias("generated_at"),
        "duration_sec",
        vehicles.cast("double").alias("vehicles_count"),
        F.col("speed.count").alias("speed_count"),
        F.col("speed.avg_kmh").alias("speed_avg_kmh"),
        F.col("speed.min_kmh").alias("speed_min_kmh"),
        F.col("speed.max_kmh").alias("speed_max_kmh"),
        series.alias("speed_series"),
        clean.flat_weather(F.col("weather")).alias("weather"),
    )
