"""Full calendars and smoothing over one row per day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def fill_calendar(daily: DataFrame, day: str = "day") -> DataFrame:
    """Every day between the first and the last, with NULL measures where a day is missing.

    Each day is stretched to the eve of the next one, so the input is computed once. The
    window is one partition, which holds one row per day.
    """
    followed = daily.withColumn("_next", F.lead(day).over(W.orderBy(day)))
    reach = F.sequence(F.col(day), F.coalesce(F.date_sub("_next", 1), F.col(day)))
    spread = followed.withColumn("_day", F.explode(reach))
    own = F.col("_day") == F.col(day)
    measures = [F.when(own, F.col(c)).alias(c) for c in daily.columns if c != day]
    return spread.select(F.col("_day").alias(day), *measures)


def centred_mean(value: str, order: str, reach: int, by: list[str] | None = None):
    """Mean over the row and ``reach`` neighbours on each side, ignoring NULLs.

    Neighbours are rows, not values. Use it on aggregated rows only: without ``by`` the
    window is one partition, which holds one row per calendar day.
    """
    window = W.partitionBy(*(by or [])).orderBy(order).rowsBetween(-reach, reach)
    return F.avg(value).over(window)
