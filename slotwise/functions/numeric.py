"""Rounding, safe division, array access and mergeable averages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from slotwise.functions.labels import CONGESTED_BELOW


def rounded(value: Column, digits: int = 1) -> Column:
    """Round half up by scaling, which engines agree on digit for digit."""
    scale = 10.0**digits
    return F.round(value * scale) / scale


def safe_divide(numerator: Column, denominator: Column, default: float = 0.0) -> Column:
    """``default`` for a zero or missing denominator."""
    usable = denominator.isNotNull() & (denominator != 0)
    return F.when(usable, F.try_divide(numerator, denominator)).otherwise(F.lit(default))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double division that gives NULL for a zero denominator."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def percent(part: Column, whole: Column, digits: int | None = 1) -> Column:
    share = F.try_divide(part.cast("double") * 100.0, whole.cast("double"))
    return share if digits is None else rounded(share, digits)


def array_at(values: Column, position: int) -> Column:
    """1-based element, NULL beyond the end."""
    return F.try_element_at(values, F.lit(position))


def slot_partials() -> list[Column]:
    """Mergeable measures of a group of slots.

    Summing these again over a coarser key gives that key's counts and averages, so
    rows are reduced per camera before any join or any second shuffle.
    """
    measures = {
        "slots": "count(1)",
        "vehicles_sum": "sum(vehicles_count)",
        "vehicles_n": "count(vehicles_count)",
        "speed_sum": "sum(speed_avg_kmh)",
        "speed_n": "count(speed_avg_kmh)",
        "slow_slots": f"count_if(speed_avg_kmh < {CONGESTED_BELOW})",
    }
    return [F.expr(f"{measure} AS {name}") for name, measure in measures.items()]


def merged_slots() -> Column:
    return F.sum("slots")


def merged_vehicles() -> Column:
    return ratio(F.sum("vehicles_sum"), F.sum("vehicles_n"))


def merged_speed() -> Column:
    return ratio(F.sum("speed_sum"), F.sum("speed_n"))
