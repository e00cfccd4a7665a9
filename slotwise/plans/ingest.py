"""The batch job: cleaned feeds to stored slots."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime, time, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise import schemas
from slotwise.functions.timekeys import slot_previous
from slotwise.operators import slots
from slotwise.session import fresh_dir
from slotwise.sources import json_feed, sinks, versions
from slotwise.sources.tables import StoredTables

#: The tables of a run, and how their files are sorted.
TABLES = {"speed_samples": ("camera_id", "slot", "time"), "frames": ("camera_id", "slot", "time"), "events": ("camera_id", "slot")}


def complete_only(records: DataFrame, as_of: datetime) -> DataFrame:
    """Records of slots that were over at ``as_of``."""
    return records.where(F.col("slot") <= slot_previous(F.lit(as_of).cast("timestamp_ntz")))


def store_slots(
    frames: DataFrame, samples: DataFrame, weather: DataFrame, tables: StoredTables, as_of: datetime,
    whole_days: bool = True,
) -> int | None:
    """Write the complete slots of the feeds: slot rows, samples and frames, in long form;
    returns the version that readers see from then on, None where there was nothing to do.

    ``frames`` and ``samples`` are cleaned, ``weather`` is one row per slot. The days that
    the feeds mention are replaced in all three tables, also where a feed has nothing for a
    day. With ``whole_days`` off, only the (camera, slot) pairs that the feeds mention are
    replaced, and the days' other slots stay.

    Each feed is read once: samples and frames go to the run's folders as they are, and the
    slot rows are computed from what was written there. Nothing is replaced in place; the
    last step commits all days of the run together, and a job that stops before it changes
    nothing. Feeds may come from the tables that are written.
    """
    spark, run = tables.spark, versions.new_run()
    frames, samples, weather = (complete_only(feed, as_of) for feed in (frames, samples, weather))

    def add(name: str, rows: DataFrame) -> None:
        sinks.add_run(rows, f"{tables.root}/runs/{name}", run, TABLES[name])

    def written(name: str, schema) -> DataFrame:
        if not versions.written_days(spark, tables.root, name, run):
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(f"{tables.root}/runs/{name}/run={run}")

    add("speed_samples", samples.withColumn("time", F.col("time").try_cast("timestamp_ntz")).select(*schemas.SPEED_SAMPLES.fieldNames()))
    add("frames", frames.select(*schemas.FRAMES.fieldNames()))
    documents = slots.slot_documents(
        written("frames", schemas.FRAMES), written("speed_samples", schemas.SPEED_SAMPLES), weather, arrays=False
    )
    add("events", slots.flatten_documents(documents).drop("speed_series"))
    days = versions.written_days(spark, tables.root, "events", run)  # one per day
    if not days:
        return None
    if not whole_days:
        # The run's folder grows while its slots are looked up.
        touched = _settled(written("events", schemas.EVENTS).select(*slots.KEYS), "touched")
        _add_others(tables, add, touched, days)
    return versions.commit(spark, tables.root, run, list(TABLES), days)


def _settled(df: DataFrame, label: str) -> DataFrame:
    path = fresh_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _add_others(tables: StoredTables, add: Callable[[str, DataFrame], None], touched: DataFrame, days: list[date]) -> None:
    """The other slots of the days, as the version before has them."""
    if not tables.exists():
        return
    start, end = datetime.combine(min(days), time.min), datetime.combine(max(days) + timedelta(days=1), time.min)
    for name, rows in (("events", tables.events), ("speed_samples", tables.samples), ("frames", tables.frames)):
        kept = rows(start, end).drop("speed_series").where(F.to_date("slot").isin(*days))
        add(name, kept.join(touched, slots.KEYS, "left_anti"))


def ingest(
    tables: StoredTables, raw: str, bucket: str, as_of: datetime, pattern: str = json_feed.JSON_SUFFIX,
    whole_days: bool = True,
) -> int | None:
    """Raw JSON objects under ``raw``/manifest, /speed and /weather to the stored tables.

    Camera and slot are fields of the records; weather documents of one slot are taken in
    the order of their ``stored_at``.
    """
    spark = tables.spark

    def read(kind: str, schema) -> DataFrame:
        records = json_feed.read_json(spark, f"{raw}/{kind}", schema, pattern)
        return records.withColumn("slot", F.col("slot").try_cast("timestamp_ntz"))

    weather = read("weather", schemas.STORED_WEATHER).drop("path").where(F.col("camera_id").isNotNull())
    return store_slots(
        slots.clean_frames(read("manifest", schemas.RAW_FRAME), bucket), slots.clean_speed(read("speed", schemas.RAW_SPEED)),
        slots.latest_weather(weather, "stored_at"), tables, as_of, whole_days,
    )
