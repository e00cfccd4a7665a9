"""Top-k and latest-n."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows; give an order that ends in a unique key."""
    return df.orderBy(*order).limit(k)


def latest_slots(events: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` slots of each camera.

    Spark cuts each partition to ``n`` rows per camera before the shuffle
    (WindowGroupLimit), so a busy camera never travels whole.
    """
    newest = W.partitionBy("camera_id").orderBy(F.col("slot").desc())
    return events.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= n).drop("_rank")


def mark_top(df: DataFrame, key: str, measure: str, k: int) -> DataFrame:
    """``df`` with ``in_top``: whether ``key`` is among the ``k`` with the largest sum of ``measure``.

    For aggregated rows only: the ranking window is one partition.
    """
    total = F.sum(measure).over(W.partitionBy(key))
    place = F.dense_rank().over(W.orderBy(F.col("_total").desc_nulls_last(), F.col(key)))
    return df.withColumn("_total", total).withColumn("in_top", place <= k).drop("_total")
