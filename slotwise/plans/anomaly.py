"""Today's slots against a seven-day baseline per camera."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.functions import labels
from slotwise.functions.numeric import percent, ratio, rounded, slot_partials
from slotwise.operators.joins import join_cameras
from slotwise.plans.windows import day_start


def baseline(events: DataFrame) -> DataFrame:
    """Mean and sample deviation of the volume per camera."""
    return events.groupBy("camera_id").agg(
        F.avg("vehicles_count").alias("avg_vehicles"), F.stddev_samp("vehicles_count").alias("std_vehicles")
    )


def scored(slots: DataFrame, base: DataFrame) -> DataFrame:
    """Slots of cameras that have a baseline, with their z-score; NULL where the deviation
    is 0 or unknown."""
    z = (F.col("vehicles_count") - F.col("avg_vehicles")) / F.col("std_vehicles")
    columns = slots.select("camera_id", "slot", "vehicles_count", "speed_avg_kmh")
    return columns.join(base, "camera_id").withColumn("z_score", F.when(F.col("std_vehicles") > 0, z))


def with_baseline(src, as_of: datetime, days: int = 7) -> DataFrame:
    """Today's slots, :func:`scored` against the days before."""
    today = day_start(as_of)
    return scored(src.events(today), baseline(src.events(today - timedelta(days=days), today)))


def anomalies(src, as_of: datetime) -> DataFrame:
    """Slots with an extreme volume or with congestion, newest first."""
    z = F.col("z_score")
    scored = with_baseline(src, as_of).withColumn("is_congested", labels.is_congested(F.col("speed_avg_kmh")))
    # Flagged slots only go on to the camera join.
    flagged = scored.where((z < -labels.Z_LIMIT) | (z > labels.Z_LIMIT) | F.col("is_congested"))
    return (
        join_cameras(flagged, src.cameras())
        .select(
            "camera_id", "display_name", "district", "slot",
            rounded(F.col("vehicles_count")).alias("vehicles"),
            rounded(F.col("speed_avg_kmh")).alias("speed_kmh"),
            rounded(F.col("avg_vehicles")).alias("baseline_avg"),
            rounded(z, 2).alias("z_score"),
            "is_congested",
            labels.alert_type(z, F.col("is_congested")).alias("alert_type"),
        )
        .orderBy(F.col("slot").desc(), "camera_id")
    )


def incidents_summary(src, as_of: datetime) -> DataFrame:
    """Per district: cameras with congestion, drops and spikes today."""
    z = F.col("z_score")
    cameras = with_baseline(src, as_of).groupBy("camera_id").agg(
        *slot_partials(),
        F.count(F.when(z < -labels.Z_LIMIT, 1)).alias("drops"),
        F.count(F.when(z > labels.Z_LIMIT, 1)).alias("spikes"),
    )
    having = lambda column: F.count(F.when(F.col(column) > 0, 1))
    return (
        join_cameras(cameras, src.cameras())
        .groupBy("district")
        .agg(
            having("slow_slots").alias("congested_cams"),
            having("drops").alias("sudden_drop_cams"),
            having("spikes").alias("sudden_spike_cams"),
            rounded(ratio(F.sum("speed_sum"), F.sum("speed_n"))).alias("city_avg_speed"),
            percent(F.sum("slow_slots"), F.sum("slots")).alias("congestion_rate"),
        )
        .orderBy(F.col("congestion_rate").desc_nulls_last(), F.col("district").asc_nulls_last())
    )
