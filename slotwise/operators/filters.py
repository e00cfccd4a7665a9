"""Optional filters: an empty choice keeps everything."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.functions.timekeys import day_type


def in_list(df: DataFrame, column: str, values: Sequence[str] | None) -> DataFrame:
    return df.where(F.col(column).isin(*values)) if values else df


def on_day_type(df: DataFrame, wanted: str | None, column: str = "slot") -> DataFrame:
    """``Workday``, ``Weekend`` or None for all days."""
    return df.where(day_type(F.col(column)) == wanted) if wanted else df
