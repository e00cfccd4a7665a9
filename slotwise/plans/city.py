"""City-wide and per-district reports."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.functions import labels
from slotwise.functions import timekeys as tk
from slotwise.functions.numeric import merged_slots, merged_speed, merged_vehicles, percent, ratio, rounded
from slotwise.operators.joins import join_cameras, left_join_slots
from slotwise.operators.ranking import top
from slotwise.operators.rollup import per_camera, per_camera_with_place
from slotwise.plans.windows import day_start, trailing


def traffic_events(src, as_of: datetime, days: float = 1) -> DataFrame:
    """Slots of the window with their weather and camera attributes."""
    joined = join_cameras(src.events(*trailing(as_of, days)), src.cameras())
    return joined.select(
        "camera_id", "slot", "generated_at", "duration_sec", "vehicles_count",
        "speed_count", "speed_avg_kmh", "speed_min_kmh", "speed_max_kmh",
        F.col("weather.main").alias("weather_main"),
        F.col("weather.temp").alias("weather_temp"),
        F.col("weather.humidity").alias("weather_humidity"),
        F.col("weather.wind_speed").alias("weather_wind_speed"),
        F.col("weather.clouds_all").alias("weather_clouds"),
        "display_name", "district", "location_lon", "location_lat",
        F.col("status").alias("camera_status"), "ptz", "cam_type",
    )


def rush_offpeak(src, as_of: datetime, days: float = 1) -> DataFrame:
    """Mean vehicles per district in and out of rush hours."""
    events = src.events(*trailing(as_of, days))
    slots = per_camera_with_place(src, events, tk.time_period(F.col("slot")).alias("time_period"))
    return slots.groupBy("district", "time_period").agg(rounded(merged_vehicles()).alias("avg_vehicles"))


def rush_pivot(src, as_of: datetime, days: float = 1) -> DataFrame:
    """:func:`rush_offpeak` as one row per district."""
    long = rush_offpeak(src, as_of, days).where(F.col("district").isNotNull())
    wide = long.groupBy("district").pivot("time_period", ["Rush Hour", "Off-Peak"]).agg(F.first("avg_vehicles"))
    return wide.withColumnsRenamed({"Rush Hour": "rush_hour", "Off-Peak": "off_peak"}).orderBy("district")


def city_kpi(src, as_of: datetime, days: float = 1) -> DataFrame:
    """One row per day: active cameras, slots, averages and total volume."""
    daily = per_camera(src.events(*trailing(as_of, days)), F.to_date("slot").alias("day"))
    return (
        daily.groupBy("day")
        .agg(
            F.count("camera_id").alias("active_cameras"),
            merged_slots().alias("total_events"),
            rounded(merged_vehicles()).alias("avg_vehicles"),
            rounded(merged_speed()).alias("avg_speed"),
            rounded(F.sum("vehicles_sum"), 0).alias("total_volume"),
        )
        .orderBy("day")
    )


def city_status(src, as_of: datetime) -> DataFrame:
    """Per district, all cameras against today's activity.

    A camera without slots today still counts as one (empty) row in the congestion share.
    """
    today = per_camera(src.events(day_start(as_of)))
    cameras = left_join_slots(src.cameras(), today)
    return (
        cameras.groupBy("district")
        .agg(
            F.count("camera_id").alias("total_cams"),
            F.count("slots").alias("active_cams"),
            rounded(merged_vehicles()).alias("avg_volume"),
            rounded(merged_speed()).alias("avg_speed"),
            percent(F.sum(F.coalesce("slow_slots", F.lit(0))), F.sum(F.coalesce("slots", F.lit(1)))).alias("congestion_pct"),
        )
        .where(F.col("total_cams") > 0)
        .orderBy(F.col("avg_volume").desc_nulls_last(), "district")
    )


def top_congestion(src, as_of: datetime, days: float = 1, k: int = 15) -> DataFrame:
    """Cameras with the largest share of congested slots."""
    slots = per_camera_with_place(src, src.events(*trailing(as_of, days)))
    named = slots.groupBy("display_name", "district").agg(
        rounded(merged_vehicles()).alias("avg_volume"),
        rounded(merged_speed()).alias("avg_speed"),
        percent(F.sum("slow_slots"), merged_slots()).alias("congestion_pct"),
        merged_slots().alias("event_count"),
    )
    return top(named, k, F.col("congestion_pct").desc_nulls_last(), F.col("display_name"), F.col("district"))


def dow_profile(src, as_of: datetime, days: float = 7) -> DataFrame:
    """Averages and active cameras per weekday (1 = Sunday)."""
    slot = F.col("slot")
    slots = per_camera(src.events(*trailing(as_of, days)), F.dayofweek(slot).alias("dow_num"), tk.day_short(slot).alias("dow"))
    return (
        slots.groupBy("dow_num", "dow")
        .agg(
            rounded(merged_vehicles()).alias("avg_volume"),
            rounded(merged_speed()).alias("avg_speed"),
            F.count("camera_id").alias("active_cams"),
        )
        .orderBy("dow_num")
    )


def operations_kpi(src, as_of: datetime, days: float = 1) -> DataFrame:
    """One row. ``total_events`` counts distinct cameras, as the report names it."""
    start, end = trailing(as_of, days)
    last_hour = F.col("slot") >= F.lit(end - timedelta(hours=1)).cast("timestamp_ntz")
    slots = per_camera(src.events(start, end), extra=(F.count(F.when(last_hour, 1)).alias("recent"),))
    return slots.agg(
        F.count("camera_id").alias("total_events"),
        rounded(merged_speed()).alias("avg_speed"),
        percent(F.sum("slow_slots"), merged_slots()).alias("congestion_pct"),
        F.count(F.when(F.col("recent") > 0, 1)).alias("active_cams_1h"),
        rounded(F.sum("vehicles_sum"), 0).alias("total_vehicles"),
    )


def congestion_by_district(src, as_of: datetime, days: float = 1, k: int = 15) -> DataFrame:
    """Districts with the most congested slots, among slots with a speed."""
    measured = src.events(*trailing(as_of, days)).where(F.col("speed_avg_kmh").isNotNull())
    slots = per_camera_with_place(src, measured)
    districts = slots.groupBy("district").agg(
        F.sum("slow_slots").alias("congestion_slots"),
        merged_slots().alias("total_slots"),
        percent(F.sum("slow_slots"), merged_slots()).alias("congestion_rate"),
        rounded(merged_speed()).alias("avg_speed"),
    )
    return top(districts, k, F.col("congestion_slots").desc(), F.col("district").asc_nulls_last())


def traffic_scatter(src, as_of: datetime, days: float = 1) -> DataFrame:
    """Volume against speed per known district."""
    slots = per_camera_with_place(src, src.events(*trailing(as_of, days)))
    return (
        slots.where(F.col("district").isNotNull())
        .groupBy("district")
        .agg(
            rounded(merged_vehicles()).alias("avg_vehicles"),
            rounded(merged_speed()).alias("avg_speed"),
            merged_slots().alias("event_count"),
        )
        .orderBy(F.col("event_count").desc(), "district")
    )


# Overview page


def kpi_overview(src, as_of: datetime, days: float = 7) -> DataFrame:
    """Cameras, slots, averages and the share of cameras that are up."""
    slots = per_camera_with_place(src, src.events(*trailing(as_of, days)))
    up = F.count(F.when(F.col("status") == "UP", 1))
    return slots.agg(
        F.count("camera_id").alias("total_cams"),
        F.coalesce(merged_slots(), F.lit(0)).alias("total_events"),
        merged_speed().alias("avg_speed"),
        merged_vehicles().alias("avg_vehicles"),
        up.alias("up_cams"),
        F.coalesce(percent(up, F.count("camera_id"), None), F.lit(0.0)).alias("health_pct"),
    )


def kpi_delta(src, as_of: datetime, days: float = 7) -> DataFrame:
    """Change of the averages against the "previous" data.

    The previous data is a window of twice the length, cut at the newest slot of the
    current one: the two overlap, and that is kept.
    """
    start, end = trailing(as_of, days)
    latest = src.events(start, end).groupBy("camera_id").agg(F.max("slot").alias("newest"))
    newest = join_cameras(latest, src.cameras()).agg(F.max("newest"))
    slots = src.events(*trailing(as_of, days * 2)).withColumns({
        "_avg": F.col("slot") >= F.lit(start).cast("timestamp_ntz"),
        "_prev": F.col("slot") < newest.scalar(),
    })
    measures = {"speed": "speed_avg_kmh", "vehicles": "vehicles_count"}
    partials, means = [], []
    for name, column in measures.items():
        for period in ("_avg", "_prev"):
            inside = F.when(F.col(period), F.col(column))
            total, rows = f"{period}_{name}_sum", f"{period}_{name}_n"
            partials += [F.sum(inside).alias(total), F.count(inside).alias(rows)]
            means.append(ratio(F.sum(total), F.sum(rows)).alias(f"{period[1:]}_{name}"))
    cameras = join_cameras(slots.groupBy("camera_id").agg(*partials), src.cameras())
    averages = cameras.agg(*means)
    change = lambda name: F.when(F.col(f"prev_{name}") > 0, F.col(f"avg_{name}") - F.col(f"prev_{name}"))
    return averages.withColumns({"delta_speed": change("speed"), "delta_vehicles": change("vehicles")})


def map_points(src, as_of: datetime, days: float = 7) -> DataFrame:
    """Located cameras with averages, colour and marker size; incomplete keys are dropped."""
    slots = per_camera_with_place(src, src.events(*trailing(as_of, days)))
    keys = ["camera_id", "display_name", "district", "location_lat", "location_lon"]
    points = slots.dropna(subset=keys).groupBy(*keys).agg(
        merged_speed().alias("avg_speed"),
        merged_vehicles().alias("avg_vehicles"),
        F.sum("vehicles_n").alias("slots"),
    )
    return points.withColumns({
        "color": labels.SPEED_COLOUR.label(F.col("avg_speed")),
        "size": labels.marker_size(F.col("avg_vehicles")),
    })


def _named(src, as_of: datetime, days: float) -> DataFrame:
    slots = per_camera_with_place(src, src.events(*trailing(as_of, days)))
    return slots.dropna(subset=["display_name", "district"]).groupBy("display_name", "district").agg(
        rounded(merged_vehicles()).alias("avg_vehicles"), rounded(merged_speed()).alias("avg_speed")
    )


def top_busiest(src, as_of: datetime, days: float = 7, k: int = 10) -> DataFrame:
    named = _named(src, as_of, days).drop("avg_speed")
    return top(named, k, F.col("avg_vehicles").desc_nulls_last(), F.col("display_name"), F.col("district"))


def top_slowest(src, as_of: datetime, days: float = 7, k: int = 10) -> DataFrame:
    named = _named(src, as_of, days).withColumn("band", labels.SPEED_ALARM.label(F.col("avg_speed")))
    return top(named, k, F.col("avg_speed").asc_nulls_last(), F.col("display_name"), F.col("district"))


def district_summary(src, as_of: datetime, days: float = 7, k: int = 20) -> DataFrame:
    """The slowest districts; slots without a speed stay in the congestion denominator."""
    slots = per_camera_with_place(src, src.events(*trailing(as_of, days)))
    districts = slots.where(F.col("district").isNotNull()).groupBy("district").agg(
        F.count("camera_id").alias("cameras"),
        rounded(merged_vehicles()).alias("avg_vehicles"),
        rounded(merged_speed()).alias("avg_speed"),
        percent(F.sum("slow_slots"), merged_slots()).alias("congestion_rate"),
    )
    ranked = top(districts, k, F.col("avg_speed").asc_nulls_last(), F.col("district"))
    return ranked.withColumn("condition", labels.SPEED_STATUS.label(F.col("avg_speed")))


def speed_shares(src, as_of: datetime, days: float = 7) -> DataFrame:
    """Slots per speed range and their share; a missing speed is in no range."""
    speed = F.col("speed_avg_kmh")
    # The ranges of the overview page.
    ranges = ("< 10 km/h", "10-20 km/h", "20-30 km/h", "30-40 km/h", "> 40 km/h")
    bottom = F.least(F.greatest(F.floor(speed / 10), F.lit(0)), F.lit(4))
    slots = src.events(*trailing(as_of, days)).where(speed.isNotNull())
    per_range = slots.groupBy("camera_id", bottom.alias("range_no")).agg(F.count(F.lit(1)).alias("n"))
    counted = join_cameras(per_range, src.cameras()).groupBy("range_no").agg(F.sum("n").alias("n"))
    wide = counted.agg(*[
        F.coalesce(F.sum(F.when(F.col("range_no") == i, F.col("n"))), F.lit(0)).alias(f"c{i}") for i in range(len(ranges))
    ])
    total = sum((F.col(f"c{i}") for i in range(1, len(ranges))), F.col("c0"))
    rows = F.array(*[
        F.struct(
            F.lit(i + 1).alias("range_no"), F.lit(name).alias("speed_range"), F.col(f"c{i}").alias("slots"),
            F.coalesce(percent(F.col(f"c{i}"), total), F.lit(0.0)).alias("share_pct"),
        )
        for i, name in enumerate(ranges)
    ])
    return wide.select(F.inline(rows)).orderBy("range_no")
