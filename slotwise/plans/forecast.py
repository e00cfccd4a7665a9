"""Forecasts against what happened. Array element 1 is the next slot."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.functions import labels
from slotwise.functions import timekeys as tk
from slotwise.functions.numeric import array_at, ratio, rounded
from slotwise.operators.joins import join_cameras, join_predicts
from slotwise.operators.ranking import top
from slotwise.plans.windows import trailing


def _count(step: int) -> Column:
    return array_at(F.col("count_preds"), step)


def _speed(step: int) -> Column:
    return array_at(F.col("avg_kmh_preds"), step)


def _paired(src, as_of: datetime, days: float) -> DataFrame:
    """Slots with their forecast. Both scans take the window, so both are pruned."""
    window = trailing(as_of, days)
    return join_predicts(src.events(*window), src.predicts(*window))


def predictions(src, as_of: datetime, days: float = 1) -> DataFrame:
    """Actual values, first forecasts and the absolute error of the count."""
    joined = join_cameras(_paired(src, as_of, days), src.cameras())
    return joined.select(
        "camera_id", "slot",
        F.col("vehicles_count").alias("actual_count"),
        F.col("speed_avg_kmh").alias("actual_speed"),
        F.col("weather.main").alias("weather_main"),
        F.col("weather.temp").alias("weather_temp"),
        "display_name", "district", "location_lon", "location_lat",
        _count(1).alias("pred_count_t1"),
        _speed(1).alias("pred_speed_t1"),
        F.abs(F.col("vehicles_count") - _count(1)).alias("count_error_abs"),
    )


def forecast_frame(src, as_of: datetime, days: float = 1) -> DataFrame:
    """The actual, forecast and error columns alone."""
    return predictions(src, as_of, days).select(
        "camera_id", "slot", "actual_count", "actual_speed", "pred_count_t1", "pred_speed_t1", "count_error_abs"
    )


def ml_performance(src, as_of: datetime, days: float = 7) -> DataFrame:
    """Daily mean absolute errors and means."""
    return (
        _paired(src, as_of, days)
        .groupBy(F.to_date("slot").alias("day"))
        .agg(
            rounded(F.avg(F.abs(F.col("vehicles_count") - _count(1)))).alias("mae_count"),
            rounded(F.avg(F.abs(F.col("speed_avg_kmh") - _speed(1)))).alias("mae_speed"),
            rounded(F.avg(_count(1))).alias("avg_predicted"),
            rounded(F.avg("vehicles_count")).alias("avg_actual"),
            F.count(F.lit(1)).alias("sample_count"),
        )
        .orderBy("day")
    )


def ml_accuracy(src, as_of: datetime, days: float = 7) -> DataFrame:
    """Errors per district; slots with an actual count of 0 are left out of the percentage."""
    actual = F.col("vehicles_count")
    error = F.abs(actual - _count(1))
    speed_error = F.abs(F.col("speed_avg_kmh") - _speed(1))
    share = F.try_divide(error * 100.0, actual)
    measures = {"count": error, "speed": speed_error, "share": share}
    partials = [F.count(F.lit(1)).alias("samples")]
    for name, measure in measures.items():
        partials += [F.sum(measure).alias(f"{name}_sum"), F.count(measure).alias(f"{name}_n")]
    cameras = join_cameras(_paired(src, as_of, days).groupBy("camera_id").agg(*partials), src.cameras())
    mean = lambda name: rounded(ratio(F.sum(f"{name}_sum"), F.sum(f"{name}_n")))
    return (
        cameras.groupBy("district")
        .agg(
            mean("count").alias("mae_count"),
            mean("speed").alias("mae_speed"),
            mean("share").alias("mape_count"),
            F.sum("samples").alias("samples"),
        )
        .orderBy(F.col("mae_count").desc_nulls_last(), F.col("district").asc_nulls_last())
    )


def prediction_trend(src, as_of: datetime, days: float = 1) -> DataFrame:
    """Hourly actual speed against forecasts 1, 7 and 12 slots ahead."""
    slot = F.col("slot")
    return (
        _paired(src, as_of, days)
        .groupBy(F.to_date(slot).alias("day"), F.hour(slot).alias("hour"), tk.hour_block(slot, 4).alias("time_block"))
        .agg(
            rounded(F.avg("speed_avg_kmh")).alias("actual_speed"),
            *[rounded(F.avg(_speed(step))).alias(f"pred_speed_t{step}") for step in (1, 7, 12)],
            rounded(F.avg(F.abs(F.col("speed_avg_kmh") - _speed(1))), 2).alias("mae_t1"),
            F.count(F.lit(1)).alias("sample_count"),
        )
        .orderBy("day", "time_block", "hour")
    )


def prediction_risk(src, as_of: datetime, hours: float = 1) -> DataFrame:
    """Forecasts per risk level, highest risk first."""
    ahead = _speed(1)
    rows = src.predicts(*trailing(as_of, hours=hours))
    return (
        rows.groupBy(labels.RISK_LEVEL.label(ahead).alias("risk_level"), labels.RISK_LEVEL.rank(ahead).alias("_rank"))
        .agg(F.count(F.lit(1)).alias("camera_count"), rounded(F.avg(ahead)).alias("avg_predicted_speed"))
        .orderBy("_rank")
        .drop("_rank")
    )


def prediction_congestion(src, as_of: datetime, hours: float = 1, k: int = 15) -> DataFrame:
    """Cameras with the most forecasts of congestion."""
    ahead = _speed(1)
    cameras = src.predicts(*trailing(as_of, hours=hours)).groupBy("camera_id").agg(
        F.count(F.when(ahead < labels.CONGESTED_BELOW, 1)).alias("slow"),
        F.count(F.lit(1)).alias("n"),
        F.min(ahead).alias("low"),
    )
    named = (
        join_cameras(cameras, src.cameras())
        .groupBy("display_name", "district")
        .agg(
            F.sum("slow").alias("congestion_predictions"),
            F.sum("n").alias("total_predictions"),
            rounded(F.min("low")).alias("min_predicted_speed"),
        )
        .where(F.col("congestion_predictions") > 0)
    )
    return top(named, k, F.col("congestion_predictions").desc(), F.col("display_name"), F.col("district"))
