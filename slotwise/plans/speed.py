"""Speed reports."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slotwise.functions import labels
from slotwise.functions import timekeys as tk
from slotwise.functions.numeric import merged_speed, merged_vehicles, rounded
from slotwise.operators.calendar import centred_mean
from slotwise.operators.filters import in_list
from slotwise.operators.joins import join_cameras
from slotwise.operators.quantiles import exact_quantiles
from slotwise.operators.ranking import top
from slotwise.operators.rollup import per_camera, per_camera_with_place
from slotwise.plans.windows import trailing


def flow_speed_trend(src, as_of: datetime, days: float = 7) -> DataFrame:
    """Volume and speed per day and hour."""
    events = src.events(*trailing(as_of, days))
    slot = F.col("slot")
    hourly = events.groupBy(F.to_date(slot).alias("day"), F.hour(slot).alias("hour")).agg(
        rounded(F.avg("vehicles_count")).alias("avg_volume"),
        rounded(F.avg("speed_avg_kmh")).alias("avg_speed"),
        F.count(F.lit(1)).alias("event_count"),
    )
    return hourly.withColumn("day_type", tk.day_type(F.col("day"))).orderBy("day", "hour")


def _speed_bands(src, as_of, days, bands: labels.Bands, name: str, average: str) -> DataFrame:
    speed = F.col("speed_avg_kmh")
    banded = src.events(*trailing(as_of, days)).groupBy(bands.label(speed).alias(name), bands.rank(speed).alias("_rank"))
    counted = banded.agg(F.count(F.lit(1)).alias("event_count"), rounded(F.avg("vehicles_count")).alias(average))
    return counted.orderBy("_rank").drop("_rank")


def speed_bins(src, as_of: datetime, days: float = 7) -> DataFrame:
    """Slots per 10 km/h bin; a missing speed is counted in the last bin."""
    return _speed_bands(src, as_of, days, labels.SPEED_BIN, "speed_bin", "avg_volume")


def speed_distribution(src, as_of: datetime, days: float = 1) -> DataFrame:
    """Slots per named speed category, slowest first; a missing speed is in the last one."""
    return _speed_bands(src, as_of, days, labels.SPEED_CATEGORY, "speed_category", "avg_vehicles")


def hourly_pattern(src, as_of: datetime, days: float = 7) -> DataFrame:
    """Averages and active cameras per hour of day."""
    slots = per_camera(src.events(*trailing(as_of, days)), F.hour("slot").alias("hour"))
    return (
        slots.groupBy("hour")
        .agg(
            rounded(merged_vehicles()).alias("avg_volume"),
            rounded(merged_speed()).alias("avg_speed"),
            F.count("camera_id").alias("active_cams"),
        )
        .orderBy("hour")
    )


# Speed page


def slowest_districts(src, as_of: datetime, days: float = 7, k: int = 5) -> DataFrame:
    """The default selection: districts with the lowest mean speed."""
    slots = per_camera_with_place(src, src.events(*trailing(as_of, days)))
    means = slots.where(F.col("district").isNotNull()).groupBy("district").agg(merged_speed().alias("avg_speed"))
    return top(means, k, F.col("avg_speed").asc_nulls_last(), F.col("district"))


def speed_kpi(src, as_of: datetime, days: float = 7) -> DataFrame:
    """One row: mean, 5th percentile, congested slots and their share, rush-hour mean."""
    events = src.events(*trailing(as_of, days))
    rush = tk.time_period(F.col("slot"), tk.RUSH_HOURS_SPEED_PAGE) == "Rush Hour"
    slots = per_camera_with_place(src, events, rush.alias("rush"))
    measured = events.where(F.col("speed_avg_kmh").isNotNull())
    values = join_cameras(
        measured.groupBy("camera_id", "speed_avg_kmh").agg(F.count(F.lit(1)).alias("n")), src.cameras()
    )
    low = exact_quantiles(values, "speed_avg_kmh", [0.05], weight="n")
    in_rush = F.col("rush")
    rush_mean = F.try_divide(
        F.sum(F.when(in_rush, F.col("speed_sum"))), F.sum(F.when(in_rush, F.col("speed_n"))).cast("double")
    )
    return slots.agg(
        merged_speed().alias("avg_speed"),
        F.sum("slow_slots").alias("congested"),
        F.sum("speed_n").alias("total"),
        F.when(F.count(F.when(in_rush, 1)) > 0, rush_mean).otherwise(F.lit(0.0)).alias("rush_avg"),
    ).select(
        "avg_speed", low.select("quantile").scalar().alias("p5_speed"), "congested", "total",
        F.try_divide(F.col("congested") * F.lit(100.0), F.col("total").cast("double")).alias("congested_pct"),
        "rush_avg",
    )


def speed_histogram(src, as_of: datetime, days: float = 7, width: int = 5, end: int = 60) -> DataFrame:
    """Positive speeds in bins of ``width`` up to ``end``."""
    speed = F.col("speed_avg_kmh")
    kept = src.events(*trailing(as_of, days)).where((speed > 0) & (speed < end))
    bins = kept.groupBy("camera_id", (F.floor(speed / width) * width).alias("bin_start")).agg(F.count(F.lit(1)).alias("n"))
    return join_cameras(bins, src.cameras()).groupBy("bin_start").agg(F.sum("n").alias("slots")).orderBy("bin_start")


def district_hour_speed(src, as_of: datetime, days: float = 7, districts: Sequence[str] | None = None) -> DataFrame:
    """Mean speed per known district and hour."""
    slots = per_camera_with_place(src, src.events(*trailing(as_of, days)), F.hour("slot").alias("hour"))
    chosen = in_list(slots, "district", districts).where(F.col("district").isNotNull())
    return chosen.groupBy("district", "hour").agg(merged_speed().alias("avg_speed"))


def speed_heat(src, as_of: datetime, days: float = 7, districts: Sequence[str] | None = None) -> DataFrame:
    """:func:`district_hour_speed` with the row mean, slowest district first."""
    cells = district_hour_speed(src, as_of, days, districts)
    row_mean = F.avg("avg_speed").over(W.partitionBy("district"))
    return cells.withColumn("district_mean", row_mean).orderBy(F.col("district_mean").asc_nulls_last(), "district", "hour")


def congestion_index(src, as_of: datetime, days: float = 7) -> DataFrame:
    """Rush-hour mean speed per district, slowest first, with its alarm colour."""
    rush = F.hour("slot").isin(*tk.RUSH_HOURS_SPEED_PAGE)
    slots = per_camera_with_place(src, src.events(*trailing(as_of, days)).where(rush))
    means = slots.where(F.col("district").isNotNull()).groupBy("district").agg(merged_speed().alias("avg_speed"))
    return means.withColumn("band", labels.SPEED_ALARM.label(F.col("avg_speed"))).orderBy(
        F.col("avg_speed").asc_nulls_last(), "district"
    )


def speed_smoothed(src, as_of: datetime, days: float = 7, districts: Sequence[str] | None = None) -> DataFrame:
    """District-hour speeds with a centred mean over three neighbouring rows."""
    cells = district_hour_speed(src, as_of, days, districts)
    return cells.withColumn("speed_ma3", centred_mean("avg_speed", "hour", 1, ["district"])).orderBy("district", "hour")


def suspicious_districts(src, as_of: datetime, days: float = 7, districts: Sequence[str] | None = None) -> DataFrame:
    """Districts whose hourly speeds are high and hardly vary: a sign of a faulty camera."""
    cells = district_hour_speed(src, as_of, days, districts)
    spread = cells.groupBy("district").agg(
        F.avg("avg_speed").alias("mean_speed"), F.stddev_samp("avg_speed").alias("std_speed")
    )
    flag = (F.col("mean_speed") > 35) & (F.col("std_speed") < 3)
    return spread.withColumn("is_suspicious", F.coalesce(flag, F.lit(False))).orderBy("district")
