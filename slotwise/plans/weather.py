"""Weather reports."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slotwise.functions import timekeys as tk
from slotwise.functions.labels import CONGESTED_BELOW
from slotwise.functions.numeric import merged_slots, merged_speed, merged_vehicles, ratio, rounded
from slotwise.operators.filters import in_list
from slotwise.operators.rollup import per_camera, per_camera_with_place
from slotwise.plans.windows import trailing

# The weather classes of the model, and which of them count as wet or dry.
WEATHER_CLASSES = ("Clear", "Clouds", "Rain", "Drizzle", "Thunderstorm", "Snow", "Mist", "Fog")
WET = ("Rain", "Thunderstorm", "Drizzle")
DRY = ("Clear", "Clouds")


def _mean(column: Column | str, digits: int = 1) -> Column:
    return rounded(F.avg(column), digits)


def weather_impact(src, as_of: datetime, days: float = 7) -> DataFrame:
    """Cameras, slots and averages per weather class (unknown weather is a class)."""
    weather = F.col("weather.main").alias("weather")
    extra = tuple(
        measure.alias(f"{name}_{kind}")
        for name in ("temp", "humidity")
        for kind, measure in (("sum", F.sum(f"weather.{name}").cast("double")), ("n", F.count(f"weather.{name}")))
    )
    slots = per_camera(src.events(*trailing(as_of, days)), weather, extra=extra)
    return (
        slots.groupBy("weather")
        .agg(
            F.count("camera_id").alias("cameras"),
            merged_slots().alias("total_events"),
            rounded(merged_vehicles()).alias("avg_volume"),
            rounded(merged_speed()).alias("avg_speed"),
            rounded(ratio(F.sum("temp_sum"), F.sum("temp_n"))).alias("avg_temp"),
            rounded(ratio(F.sum("humidity_sum"), F.sum("humidity_n")), 0).alias("avg_humidity"),
        )
        .orderBy(F.col("total_events").desc(), F.col("weather").asc_nulls_last())
    )


def weather_summary(src, as_of: datetime, days: float = 7) -> DataFrame:
    events = src.events(*trailing(as_of, days))
    return (
        events.groupBy(F.col("weather.main").alias("weather"))
        .agg(
            F.count(F.lit(1)).alias("event_count"),
            _mean("vehicles_count").alias("avg_vehicles"),
            _mean("speed_avg_kmh").alias("avg_speed"),
            _mean("weather.temp").alias("avg_temp"),
            _mean("weather.humidity", 0).alias("avg_humidity"),
        )
        .orderBy(F.col("event_count").desc(), F.col("weather").asc_nulls_last())
    )


def weather_scatter(src, as_of: datetime, days: float = 7) -> DataFrame:
    """:func:`weather_summary` under the scatter chart's names."""
    return weather_summary(src, as_of, days).withColumnsRenamed(
        {"event_count": "sample_count", "avg_temp": "temp", "avg_humidity": "humidity"}
    )


def weather_hourly(src, as_of: datetime, days: float = 7, weather: str = "Rain") -> DataFrame:
    """Congested slots and mean vehicles per hour of one weather class."""
    slot = F.col("slot")
    wet = src.events(*trailing(as_of, days)).where(F.col("weather.main") == weather)
    hour = F.hour(slot)
    return (
        wet.groupBy(
            F.col("weather.main").alias("weather"), hour.alias("hour"), tk.hour_block(slot, 2).alias("hour_block"),
            tk.time_period(slot).alias("period"),
        )
        .agg(
            F.count(F.when(F.col("speed_avg_kmh") < CONGESTED_BELOW, 1)).alias("congestion_count"),
            _mean("vehicles_count").alias("avg_vehicles"),
        )
        .orderBy("hour")
    )


def hot_humid_speed(src, start=None, end=None, temp: float = 30, humidity: int = 80) -> DataFrame:
    """Mean speed per camera in hot and humid slots."""
    hot = src.events(start, end).where((F.col("weather.temp") > temp) & (F.col("weather.humidity") > humidity))
    return hot.groupBy("camera_id").agg(F.avg("speed_avg_kmh").alias("avg_speed"))


def weather_condition_agg(src, start=None, end=None) -> DataFrame:
    return src.events(start, end).groupBy(F.col("weather.main").alias("condition")).agg(
        F.count(F.lit(1)).alias("count"),
        F.avg("speed_avg_kmh").alias("avg_speed"),
        F.avg("vehicles_count").alias("avg_vehicles"),
    )


def rain_rows(src, start=None, end=None, weather: str = "Rain") -> DataFrame:
    """Slots of one weather class."""
    return src.events(start, end).where(F.col("weather.main") == weather).select(
        "camera_id", "slot", "vehicles_count", "speed_avg_kmh",
        F.col("weather.temp").alias("weather_temp"), F.col("weather.main").alias("condition"),
    )


# Weather page: slots of known cameras


def _page_slots(src, as_of, days, chosen: Sequence[str] | None, *keys: Column, extra: tuple[Column, ...] = ()) -> DataFrame:
    main = F.col("weather.main").alias("weather_main")
    events = src.events(*trailing(as_of, days)).withColumn("_main", F.col("weather.main"))
    return per_camera_with_place(src, in_list(events, "_main", chosen), main, *keys, extra=extra)


def weather_kpi(src, as_of: datetime, days: float = 7, chosen: Sequence[str] | None = None) -> DataFrame:
    """One row: commonest weather (the first by name on ties), wet against dry means, mean temperature."""
    extra = (F.sum("weather.temp").alias("temp_sum"), F.count("weather.temp").alias("temp_n"))
    classes = _page_slots(src, as_of, days, chosen, extra=extra).groupBy("weather_main").agg(
        *[F.sum(c).alias(c) for c in ("slots", "vehicles_sum", "vehicles_n", "speed_sum", "speed_n", "temp_sum", "temp_n")]
    )
    main = F.col("weather_main")

    def mean(measure: str, kinds: Sequence[str]) -> Column:
        inside = lambda c: F.sum(F.when(main.isin(*kinds), F.col(c)))
        found = F.coalesce(inside("slots"), F.lit(0)) > 0
        return F.when(found, ratio(inside(f"{measure}_sum"), inside(f"{measure}_n"))).otherwise(F.lit(0.0))

    commonest = F.min_by("weather_main", F.when(main.isNotNull(), F.struct(-F.col("slots"), main)))
    row = classes.agg(
        F.coalesce(commonest, F.lit("N/A")).alias("most_common"),
        ratio(F.sum("temp_sum"), F.sum("temp_n")).alias("avg_temp"),
        mean("vehicles", WET).alias("rain_vehicles"),
        mean("vehicles", DRY).alias("clear_vehicles"),
        mean("speed", WET).alias("rain_speed"),
        mean("speed", DRY).alias("clear_speed"),
    )
    return row.withColumns({
        "vehicles_diff": F.col("rain_vehicles") - F.col("clear_vehicles"),
        "speed_diff": F.col("rain_speed") - F.col("clear_speed"),
    })


def weather_stats(src, as_of: datetime, days: float = 7, chosen: Sequence[str] | None = None) -> DataFrame:
    """Mean vehicles, mean speed and its sample deviation per weather class."""
    speed = F.col("speed_avg_kmh")
    # Squared deviations are merged, not raw squares: those cancel for large or steady values.
    spread = ((F.var_pop(speed) * F.count(speed)).alias("speed_m2"),)
    slots = _page_slots(src, as_of, days, chosen, extra=spread).where(F.col("weather_main").isNotNull())
    # One row per camera and class here.
    whole = W.partitionBy("weather_main")
    centre = F.sum("speed_sum").over(whole) / F.sum("speed_n").over(whole)
    off = F.try_divide(F.col("speed_sum"), F.col("speed_n")) - centre
    slots = slots.withColumn("_m2", F.col("speed_m2") + F.col("speed_n") * off * off)
    n = F.sum("speed_n")
    variance = F.try_divide(F.sum("_m2"), (n - 1).cast("double"))
    return (
        slots.groupBy("weather_main")
        .agg(
            merged_vehicles().alias("avg_vehicles"),
            merged_speed().alias("avg_speed"),
            F.sqrt(variance).alias("std_speed"),
        )
        .orderBy(F.col("avg_vehicles").desc_nulls_last(), "weather_main")
    )


def weather_district(src, as_of: datetime, days: float = 7, chosen: Sequence[str] | None = None) -> DataFrame:
    """Mean speed per district and weather class, slowest district first."""
    slots = _page_slots(src, as_of, days, chosen).dropna(subset=["district", "weather_main"])
    cells = slots.groupBy("district", "weather_main").agg(merged_speed().alias("avg_speed"))
    row_mean = F.avg("avg_speed").over(W.partitionBy("district"))
    return cells.withColumn("district_mean", row_mean).orderBy(F.col("district_mean").asc_nulls_last(), "district", "weather_main")


def weather_district_wide(src, as_of: datetime, days: float = 7, chosen: Sequence[str] | None = None) -> DataFrame:
    """:func:`weather_district` with one column per weather class."""
    cells = weather_district(src, as_of, days, chosen)
    wide = cells.groupBy("district", "district_mean").pivot("weather_main", list(WEATHER_CLASSES)).agg(F.first("avg_speed"))
    return wide.orderBy(F.col("district_mean").asc_nulls_last(), "district")


def temp_vs_traffic(src, as_of: datetime, days: float = 7, chosen: Sequence[str] | None = None) -> DataFrame:
    """Mean vehicles per temperature and weather, with the marker size by sample count."""
    slots = _page_slots(src, as_of, days, chosen, F.col("weather.temp").alias("weather_temp"))
    points = slots.dropna(subset=["weather_temp", "weather_main"]).groupBy("weather_temp", "weather_main").agg(
        merged_vehicles().alias("avg_vehicles"), F.sum("vehicles_n").alias("samples")
    )
    most = F.max("samples").over(W.partitionBy("weather_main"))
    return points.withColumn("size", F.try_divide(F.col("samples").cast("double"), most.cast("double")) * 30 + 8).orderBy(
        "weather_main", "weather_temp"
    )


def humidity_scaled(src, as_of: datetime, days: float = 7, chosen: Sequence[str] | None = None) -> DataFrame:
    """Mean vehicles and humidity per weather, the latter stretched to the vehicles' scale."""
    extra = (F.sum("weather.humidity").cast("double").alias("hum_sum"), F.count("weather.humidity").alias("hum_n"))
    slots = _page_slots(src, as_of, days, chosen, extra=extra).where(F.col("weather_main").isNotNull())
    classes = slots.groupBy("weather_main").agg(
        merged_vehicles().alias("avg_vehicles"), ratio(F.sum("hum_sum"), F.sum("hum_n")).alias("avg_humidity")
    )
    # One row per weather class from here on.
    everything = W.partitionBy()
    low, high = F.min("avg_humidity").over(everything), F.max("avg_humidity").over(everything)
    spread = F.when(high != low, high - low).otherwise(F.lit(1.0))
    scaled = (F.col("avg_humidity") - low) / spread * F.max("avg_vehicles").over(everything)
    return classes.withColumn("humidity_scaled", scaled).orderBy(F.col("avg_vehicles").desc_nulls_last(), "weather_main")
