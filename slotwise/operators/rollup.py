"""Two-step roll-up of slots: per camera first, then over camera attributes.

Slots are reduced to one partial row per camera (and extra key) before they meet the
camera table, so the join input is small, no distinct count needs row expansion, and a
camera with many slots is folded in the first map-side combine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from slotwise.functions.numeric import slot_partials
from slotwise.operators.joins import join_cameras


def per_camera(events: DataFrame, *keys: Column, extra: tuple[Column, ...] = ()) -> DataFrame:
    return events.groupBy("camera_id", *keys).agg(*slot_partials(), *extra)


def per_camera_with_place(
    src, events: DataFrame, *keys: Column, extra: tuple[Column, ...] = ()
) -> DataFrame:
    return join_cameras(per_camera(events, *keys, extra=extra), src.cameras())
