"""How a query gets its name.

The windows cover the whole tables. Dates are given as text and derived averages to six
decimals, so that results compare across engines; the library itself returns neither
changed.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotwise.functions.numeric import rounded
from slotwise.sources.driver_tables import DriverTables

AS_OF = datetime(2024, 1, 30, 23, 59, 59)
DAYS = 30
HOURS = DAYS * 24
BUCKET = "traffic-data"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def comparable(df: DataFrame, digits: int | None = None) -> DataFrame:
    """Dates as text, doubles to ``digits`` decimals."""
    changed = {}
    for field in df.schema.fields:
        if isinstance(field.dataType, T.DateType):
            changed[field.name] = F.date_format(field.name, "yyyy-MM-dd")
        elif digits is not None and isinstance(field.dataType, T.DoubleType):
            changed[field.name] = rounded(F.col(field.name), digits)
    return df.withColumns(changed) if changed else df


def register(name: str, build: Callable[[DriverTables], DataFrame], digits: int | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")
    QUERIES[name] = lambda spark, sf_dir: comparable(build(DriverTables(spark, sf_dir)), digits)
