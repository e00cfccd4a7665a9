"""Camera activity and freshness."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.functions.numeric import ratio, rounded
from slotwise.operators.joins import left_join_slots
from slotwise.operators.rollup import per_camera
from slotwise.plans.windows import day_start


def camera_quality(src, as_of: datetime) -> DataFrame:
    """Every camera with its slots today, its last slot and its mean volume."""
    today = day_start(as_of)
    slots = per_camera(src.events(today, today + timedelta(days=1)), extra=(F.max("slot").alias("last_event"),))
    return left_join_slots(src.cameras(), slots).select(
        "camera_id", "display_name", "district", "cam_type",
        F.col("status").alias("camera_status"), "ptz",
        F.coalesce("slots", F.lit(0)).cast("bigint").alias("slots_today"),
        "last_event",
        rounded(ratio(F.col("vehicles_sum"), F.col("vehicles_n"))).alias("avg_vehicles"),
    )


def data_freshness(src, as_of: datetime) -> DataFrame:
    """Silent cameras first, then by the age of their last slot."""
    return camera_quality(src, as_of).drop("ptz").orderBy(F.col("last_event").asc_nulls_first(), "camera_id")
