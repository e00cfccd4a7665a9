"""Ordered bands over a number: one ``when`` chain, plus its rank for sorting."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Bands:
    """``labels[i]`` covers values below ``cuts[i]``; the last label takes the rest.

    NULL falls into the last label, as an SQL ``ELSE`` does.
    """

    cuts: tuple[float, ...]
    labels: tuple[str, ...]

    def _pick(self, value: Column, results: Sequence[object]) -> Column:
        chain = F.when(value < self.cuts[0], F.lit(results[0]))
        for cut, result in zip(self.cuts[1:], results[1:]):
            chain = chain.when(value < cut, F.lit(result))
        return chain.otherwise(F.lit(results[len(self.cuts)]))

    def label(self, value: Column) -> Column:
        return self._pick(value, self.labels)

    def rank(self, value: Column) -> Column:
        return self._pick(value, range(1, len(self.labels) + 1))


CONGESTED_BELOW = 15.0
Z_LIMIT = 3.0

# Cuts in km/h and the labels shown for them.
SPEED_BIN = Bands((10, 20, 30, 40, 50), ("0-10", "10-20", "20-30", "30-40", "40-50", "50+"))
SPEED_CATEGORY = Bands(
    (10, 20, 30, 50),
    ("Nguy cơ cao (<10)", "Kẹt nặng (10-20)", "Đông xe (20-30)", "Bình thường (30-50)", "Thông thoáng (>50)"),
)
RISK_LEVEL = Bands(
    (10, 15, 25),
    ("Nguy cơ cao (<10 km/h)", "Nguy cơ vừa (10-15)", "Cảnh báo (15-25)", "Thông thoáng (>25)"),
)
SPEED_STATUS = Bands((15, 25, 35), ("Kẹt nặng", "Đông xe", "Bình thường", "Thông thoáng"))
SPEED_COLOUR = Bands((15, 25, 35), ("red", "yellow", "light-green", "green"))
SPEED_ALARM = Bands((15, 25), ("red", "yellow", "green"))


def traffic_light(value: Column, first: float, second: float, high_is_bad: bool = True) -> Column:
    """Green / yellow / red against two thresholds; NULL compares false and lands last."""
    order = ("green", "yellow", "red") if high_is_bad else ("red", "yellow", "green")
    return Bands((first, second), order).label(value)


def gauge_band(value: Column, top: float) -> Column:
    """Green below 40 % of the scale, yellow below 70 %, red above."""
    return Bands((top * 0.4, top * 0.7), ("green", "yellow", "red")).label(value)


def bullet_band(value: Column, poor: float, satisfactory: float, good: float) -> Column:
    return Bands((poor, satisfactory, good), ("poor", "satisfactory", "good", "excellent")).label(value)


def is_congested(speed: Column) -> Column:
    return F.coalesce(speed < CONGESTED_BELOW, F.lit(False))


def alert_type(z_score: Column, congested: Column) -> Column:
    return (
        F.when(z_score < -Z_LIMIT, "Sudden Drop")
        .when(z_score > Z_LIMIT, "Sudden Spike")
        .when(congested, "Congestion")
        .otherwise("Normal")
    )


def marker_size(vehicles: Column) -> Column:
    return F.greatest(vehicles, F.lit(5.0)) / 5 + 8
