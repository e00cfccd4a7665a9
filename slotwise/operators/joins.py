"""Joins between the fact tables and the camera dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A side is broadcast only when its size is known to be below this.
BROADCAST_BYTES = 64 * 1024 * 1024


def scan_bytes(scan: DataFrame) -> int:
    """Size estimate of a plain file scan: the bytes of its files, from file listing alone."""
    return int(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def broadcast_below(df: DataFrame, size: int | None, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint when ``size`` is within ``limit``.

    Without the hint Spark shuffles both sides and AQE splits skewed partitions.
    """
    return F.broadcast(df) if size is not None and size <= limit else df


def join_cameras(facts: DataFrame, cameras: DataFrame) -> DataFrame:
    """Inner join of anything keyed by camera with the camera table."""
    return facts.join(cameras, "camera_id")


def join_predicts(events: DataFrame, predicts: DataFrame) -> DataFrame:
    """Slots with their forecast; both sides hold one row per (camera, slot)."""
    return events.join(predicts, ["camera_id", "slot"])


def left_join_slots(cameras: DataFrame, per_camera: DataFrame) -> DataFrame:
    """Every camera, with its (already filtered and reduced) slot measures where it has any."""
    return cameras.join(per_camera, "camera_id", "left")


def unnest_series(events: DataFrame) -> DataFrame:
    """One row per speed sample of slots that carry arrays; slots without samples vanish.

    Table sources keep samples in long form: ask them for ``samples()`` instead.
    """
    return events.select("camera_id", "slot", F.inline("speed_series"))
