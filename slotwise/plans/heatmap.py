"""Hour-by-weekday heat maps, all built on the hourly averages per camera."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slotwise.functions import timekeys as tk
from slotwise.functions.numeric import ratio, rounded
from slotwise.operators.filters import in_list, on_day_type
from slotwise.operators.ranking import mark_top, top
from slotwise.operators.rollup import per_camera_with_place
from slotwise.plans.windows import trailing

OTHER = "Khác"


def heatmap_hourly(src, as_of: datetime, days: float = 7, wanted_day_type: str | None = None) -> DataFrame:
    """Averages per camera, day and hour. One camera has one place, so camera keys suffice."""
    events = on_day_type(src.events(*trailing(as_of, days)), wanted_day_type)
    hourly = per_camera_with_place(src, events, F.to_date("slot").alias("day"), F.hour("slot").alias("hour"))
    day = F.col("day")
    return hourly.select(
        "day",
        F.dayofweek(day).alias("dow_num"),
        tk.day_name(day).alias("day_name"),
        tk.day_type(day).alias("day_type"),
        "hour", "district", "camera_id", "display_name",
        rounded(ratio(F.col("vehicles_sum"), F.col("vehicles_n"))).alias("avg_vehicles"),
        rounded(ratio(F.col("speed_sum"), F.col("speed_n"))).alias("avg_speed"),
        F.col("slots").alias("sample_count"),
    )


def busiest_districts(hourly: DataFrame, k: int = 5) -> DataFrame:
    """The default selection: districts with the highest mean."""
    means = hourly.where(F.col("district").isNotNull()).groupBy("district").agg(F.avg("avg_vehicles").alias("avg_vehicles"))
    return top(means, k, F.col("avg_vehicles").desc_nulls_last(), F.col("district"))


def district_options(hourly: DataFrame) -> DataFrame:
    """Known districts, sorted."""
    return hourly.where(F.col("district").isNotNull()).select("district").distinct().orderBy("district")


def district_by_hour(hourly: DataFrame) -> DataFrame:
    """Workday mean per district and hour; ``district_total`` orders the rows of the map."""
    cells = (
        hourly.where((F.col("day_type") == "Workday") & F.col("district").isNotNull())
        .groupBy("district", "hour")
        .agg(F.avg("avg_vehicles").alias("avg_vehicles"))
    )
    total = F.sum("avg_vehicles").over(W.partitionBy("district"))
    return cells.withColumn("district_total", total).orderBy(F.col("district_total").desc_nulls_last(), "district", "hour")


def district_by_hour_wide(hourly: DataFrame) -> DataFrame:
    """:func:`district_by_hour` with one column per hour."""
    cells = district_by_hour(hourly)
    wide = cells.groupBy("district", "district_total").pivot("hour", list(range(24))).agg(F.first("avg_vehicles"))
    return wide.withColumnsRenamed({str(h): f"h{h:02d}" for h in range(24)}).orderBy(
        F.col("district_total").desc_nulls_last(), "district"
    )


def camera_by_hour(hourly: DataFrame, districts: Sequence[str] | None = None, k: int = 20) -> DataFrame:
    """Mean per camera name and hour for the busiest names."""
    chosen = in_list(hourly, "district", districts).where(F.col("display_name").isNotNull())
    cells = chosen.groupBy("display_name", "hour").agg(F.avg("avg_vehicles").alias("avg_vehicles"))
    # A name's row has at most 24 cells.
    rows = cells.groupBy("display_name").agg(
        F.avg("avg_vehicles").alias("row_mean"), F.collect_list(F.struct("hour", "avg_vehicles")).alias("cells")
    )
    best = top(rows, k, F.col("row_mean").desc_nulls_last(), F.col("display_name"))
    return best.select("display_name", "row_mean", F.inline("cells")).orderBy(
        F.col("row_mean").desc_nulls_last(), "display_name", "hour"
    )


def weekday_stack(hourly: DataFrame, k: int = 6) -> DataFrame:
    """Workday totals per weekday and district, with all but the ``k`` largest districts merged.

    No hour filter applies, although the chart's title speaks of rush hours.
    """
    sums = (
        hourly.where((F.col("day_type") == "Workday") & F.col("district").isNotNull())
        .groupBy("dow_num", "day_name", "district")
        .agg(F.sum("avg_vehicles").alias("total"))
    )
    marked = mark_top(sums, "district", "total", k)
    group = F.when(F.col("in_top"), F.col("district")).otherwise(OTHER)
    return (
        marked.groupBy("dow_num", "day_name", group.alias("district"))
        .agg(F.sum("total").alias("total_vehicles"))
        .orderBy((F.col("dow_num") + 5) % 7, "district")
    )


def weekday_pattern(hourly: DataFrame, districts: Sequence[str] | None = None) -> DataFrame:
    """Mean per weekday and district, Monday first."""
    chosen = in_list(hourly, "district", districts).where(F.col("district").isNotNull())
    return (
        chosen.groupBy("dow_num", "day_name", "district")
        .agg(F.avg("avg_vehicles").alias("avg_vehicles"))
        .orderBy((F.col("dow_num") + 5) % 7, "district")
    )


def weekday_weekend(hourly: DataFrame) -> DataFrame:
    """One row: means on workdays and weekends, 0 where there are no such days."""
    on = lambda kind, column: F.coalesce(F.avg(F.when(F.col("day_type") == kind, F.col(column))), F.lit(0.0))
    return hourly.agg(
        on("Workday", "avg_vehicles").alias("workday_vehicles"),
        on("Weekend", "avg_vehicles").alias("weekend_vehicles"),
        on("Workday", "avg_speed").alias("workday_speed"),
        on("Weekend", "avg_speed").alias("weekend_speed"),
    )
