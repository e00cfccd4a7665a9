"""Daily and monthly trends of slots at known cameras."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slotwise.functions import timekeys as tk
from slotwise.functions.numeric import merged_speed, percent
from slotwise.operators.calendar import centred_mean, fill_calendar
from slotwise.operators.joins import join_cameras
from slotwise.operators.quantiles import exact_quantiles
from slotwise.operators.rollup import per_camera_with_place
from slotwise.plans.windows import trailing


def _daily(src, as_of: datetime, days: float) -> DataFrame:
    return per_camera_with_place(src, src.events(*trailing(as_of, days)), F.to_date("slot").alias("day"))


def _total():
    return F.coalesce(F.sum("vehicles_sum"), F.lit(0.0))


def trend_kpi(src, as_of: datetime, days: int = 30) -> DataFrame:
    """One row: total, days present against expected, daily mean, busiest day (earliest on ties)."""
    daily = _daily(src, as_of, days).groupBy("day").agg(_total().alias("total"))
    return daily.agg(
        F.sum("total").alias("total_vehicles"),
        F.count("day").alias("total_days"),
        F.lit(days).cast("bigint").alias("expected_days"),
        F.avg("total").alias("avg_daily"),
        F.min_by("day", F.struct(-F.col("total"), F.col("day"))).alias("peak_day"),
        F.max("total").alias("peak_volume"),
    )


def daily_volume(src, as_of: datetime, days: float = 30) -> DataFrame:
    """Total per day and district over the full calendar, 0 where there is nothing.

    ``day_is_empty`` marks days on which no district has any volume.
    """
    daily = _daily(src, as_of, days).groupBy("day", "district").agg(_total().alias("total"))
    # One row per day and district from here on; unknown districts only stretch the calendar.
    everything = W.partitionBy()
    spanned = daily.select(
        "*", F.min("day").over(everything).alias("first"), F.max("day").over(everything).alias("last")
    )
    by_district = (
        spanned.where(F.col("district").isNotNull())
        .groupBy("district", "first", "last")
        .agg(F.map_from_entries(F.collect_list(F.struct("day", "total"))).alias("totals"))
    )
    full = by_district.select(
        "district", "totals", F.explode(F.sequence("first", "last", F.expr("INTERVAL 1 DAY"))).alias("day")
    ).select("day", "district", F.expr("coalesce(try_element_at(totals, day), 0D) AS total_vehicles"))
    day_total = F.sum("total_vehicles").over(W.partitionBy("day"))
    return full.withColumn("day_is_empty", day_total == 0).orderBy("day", "district")


def daily_volume_wide(src, as_of: datetime, days: float, districts: list[str]) -> DataFrame:
    """:func:`daily_volume` with one column per named district."""
    cells = daily_volume(src, as_of, days)
    return cells.groupBy("day").pivot("district", districts).agg(F.first("total_vehicles")).fillna(0.0).orderBy("day")


def weekday_box(src, as_of: datetime, days: float = 30) -> DataFrame:
    """Box-plot figures of vehicles per slot by weekday, Monday first.

    Quartiles interpolate linearly; outliers lie beyond 1.5 interquartile ranges.
    """
    slot = F.col("slot")
    # Equal values are counted per camera first, so every later step sees few rows.
    counts = (
        src.events(*trailing(as_of, days))
        .where(F.col("vehicles_count").isNotNull())
        .groupBy("camera_id", F.dayofweek(slot).alias("dow_num"), F.col("vehicles_count").alias("v"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    values = join_cameras(counts, src.cameras()).groupBy("dow_num", "v").agg(F.sum("n").alias("n"))
    quartiles = exact_quantiles(values, "v", [0.25, 0.5, 0.75], by=["dow_num"], weight="n")
    pick = lambda p: F.max(F.when(F.col("prob") == p, F.col("quantile")))
    box = quartiles.groupBy("dow_num").agg(pick(0.25).alias("q1"), pick(0.5).alias("median"), pick(0.75).alias("q3"))
    centre = values.groupBy("dow_num").agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"))
    # `box` and `centre` hold one row per weekday.
    joined = values.join(F.broadcast(box), "dow_num").join(F.broadcast(centre), "dow_num")
    reach = (F.col("q3") - F.col("q1")) * 1.5
    outside = (F.col("v") < F.col("q1") - reach) | (F.col("v") > F.col("q3") + reach)
    rows, off = F.sum("n"), F.col("v") - F.col("mean")
    variance = F.try_divide(F.sum(off * off * F.col("n")), (rows - 1).cast("double"))
    stats = joined.groupBy("dow_num", "q1", "median", "q3", "mean").agg(
        rows.alias("n"),
        F.sqrt(variance).alias("sd"),
        F.sum(F.when(outside, F.col("n")).otherwise(F.lit(0))).alias("outliers"),
    )
    name = F.element_at(F.array(*map(F.lit, tk.DAY_NAMES)), F.col("dow_num"))
    return stats.select("dow_num", "q1", "median", "q3", "n", "mean", "sd", "outliers", name.alias("day_name")).orderBy((F.col("dow_num") + 5) % 7)


def rolling_week(src, as_of: datetime, days: float = 30) -> DataFrame:
    """Daily total and mean on the full calendar with a centred seven-day mean of the totals."""
    daily = _daily(src, as_of, days).groupBy("day").agg(
        _total().alias("daily_total"),
        F.try_divide(F.sum("vehicles_sum"), F.sum("vehicles_n").cast("double")).alias("daily_avg"),
    )
    # One row per calendar day.
    return fill_calendar(daily).withColumn("ma7", centred_mean("daily_total", "day", 3)).orderBy("day")


def month_growth(df: DataFrame, time: str, value: str) -> DataFrame:
    """Monthly totals with the change to the previous month present; the first month is dropped."""
    monthly = df.groupBy(F.date_format(time, "yyyy-MM").alias("month")).agg(
        F.coalesce(F.sum(value), F.lit(0.0)).alias("total")
    )
    # One row per month.
    before = F.lag("total").over(W.orderBy("month"))
    return (
        monthly.withColumn("_before", before)
        .where(F.col("_before").isNotNull())
        .select("month", "total", (F.try_divide(F.col("total"), F.col("_before")) - 1).alias("_change"))
        .select("month", "total", (F.col("_change") * 100).alias("growth_pct"))
        .orderBy("month")
    )


def traffic_month_growth(src, as_of: datetime, days: float = 90) -> DataFrame:
    return month_growth(_daily(src, as_of, days), "day", "vehicles_sum")


def completeness_days(src, as_of: datetime, days: float = 30) -> DataFrame:
    """Every calendar day with its total, mean speed, slot count and whether it has data."""
    daily = _daily(src, as_of, days).groupBy("day").agg(
        _total().alias("total_vehicles"), merged_speed().alias("avg_speed"), F.sum("vehicles_n").alias("event_count")
    )
    full = fill_calendar(daily)
    return full.withColumn("has_data", F.col("total_vehicles").isNotNull()).withColumn(
        "total_vehicles", F.coalesce("total_vehicles", F.lit(0.0))
    ).orderBy("day")


def completeness(src, as_of: datetime, days: float = 30) -> DataFrame:
    """One row: expected, present and missing days, and the share present."""
    present = F.count(F.when(F.col("has_data"), 1))
    everything = F.count(F.lit(1))
    return completeness_days(src, as_of, days).agg(
        everything.alias("expected_days"),
        present.alias("present_days"),
        (everything - present).alias("missing_days"),
        percent(present, everything).alias("complete_pct"),
    )
