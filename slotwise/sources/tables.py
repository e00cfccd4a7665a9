"""Stored tables: Parquet, partitioned by day."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise import schemas
from slotwise.operators.joins import broadcast_below, scan_bytes, unnest_series
from slotwise.operators.slots import KEYS, pack
from slotwise.session import path_exists
from slotwise.sources import versions


# Bytes in memory of one byte of a Parquet file, at most, for the broadcast check.
EXPANSION = 8


def in_range(df: DataFrame, column: str, start: datetime | None, end: datetime | None) -> DataFrame:
    """Half-open time range ``[start, end)``; an open side is left open."""
    if start is not None:
        df = df.where(F.col(column) >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        df = df.where(F.col(column) < F.lit(end).cast("timestamp_ntz"))
    return df


def scan_days(df: DataFrame, column: str, start: datetime | None, end: datetime | None) -> DataFrame:
    """:func:`in_range`, plus the bounds on the ``dt`` partition that Spark cannot derive itself."""
    day = lambda moment: F.lit(date(moment.year, moment.month, moment.day))
    if start is not None:
        df = df.where(F.col("dt") >= day(start))
    if end is not None:
        df = df.where(F.col("dt") <= day(end))
    return in_range(df, column, start, end)


class StoredTables:
    """The tables as :mod:`slotwise.sources.sinks` writes them under one root folder.

    Days that the batch job has committed are read from the folders of its runs, all tables
    in the same version; other days from the tables' own folders.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _read(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def _fact(self, name: str, schema, column: str, start, end) -> DataFrame:
        day = schemas.T.StructField("dt", schemas.T.DateType())
        with_day = type(schema)([*schema.fields, day])
        days = (versions.current(self.spark, self.root) or {}).get(name)
        own = path_exists(self.spark, f"{self.root}/{name}")
        rows = scan_days(self._read(name, with_day), column, start, end) if own or not days else None
        if days:
            if rows is not None:
                rows = rows.where(~F.col("dt").isin(*days))
            base = f"{self.root}/runs/{name}"
            # One folder per day of the range; the pointer table holds a row per day.
            paths = [
                f"{base}/run={run}/dt={dt.isoformat()}" for dt, run in sorted(days.items())
                if (start is None or dt >= start.date()) and (end is None or dt <= end.date())
            ]
            with_run = type(schema)([*schema.fields, schemas.T.StructField("run", schemas.T.StringType()), day])
            if paths:
                run = in_range(self.spark.read.schema(with_run).option("basePath", base).parquet(*paths), column, start, end).drop("run")
                rows = run if rows is None else rows.unionByName(run)
        return self.spark.createDataFrame([], schema) if rows is None else rows.drop("dt")

    def events(
        self, start: datetime | None = None, end: datetime | None = None, series: bool = False
    ) -> DataFrame:
        """Slot rows; ``series`` builds each slot's array from the long samples on request."""
        events = self._fact("events", schemas.EVENTS, "slot", start, end)
        if not series:
            return events
        packed = pack(self.samples(start, end), "speed_series", ["time", "speed"])
        return events.drop("speed_series").join(packed, KEYS, "left").select(*schemas.EVENTS.fieldNames())

    def exists(self) -> bool:
        """Whether any events were ever written."""
        return self._has("events")

    def _has(self, name: str) -> bool:
        return path_exists(self.spark, f"{self.root}/{name}") or bool((versions.current(self.spark, self.root) or {}).get(name))

    def _long(self, name: str, schema, start, end) -> DataFrame:
        if not self._has(name):
            return self.spark.createDataFrame([], schema)
        return self._fact(name, schema, "slot", start, end)

    def samples(self, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
        """Every speed sample; none where none were ever written."""
        return self._long("speed_samples", schemas.SPEED_SAMPLES, start, end)

    def frames(self, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
        """Every frame; none where none were ever written."""
        return self._long("frames", schemas.FRAMES, start, end)

    def predicts(self, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
        return self._fact("predicts", schemas.PREDICTS, "slot", start, end)

    def cameras(self) -> DataFrame:
        cameras = self._read("cameras", schemas.CAMERAS)
        return broadcast_below(cameras, scan_bytes(cameras) * EXPANSION)

    def metrics(
        self, names: Iterable[str] | None = None, start: datetime | None = None, end: datetime | None = None
    ) -> DataFrame:
        samples = self._fact("metrics", schemas.METRICS, "ts", start, end)
        return samples if names is None else samples.where(F.col("metric").isin(*names))


class FrameTables:
    """The same interface over DataFrames that already exist."""

    def __init__(self, events=None, cameras=None, predicts=None, metrics=None, samples=None, small_cameras=False):
        self._events, self._cameras, self._predicts = events, cameras, predicts
        self._metrics, self._samples = metrics, samples
        self._small_cameras = small_cameras

    def events(self, start=None, end=None, series=False) -> DataFrame:
        return in_range(self._events, "slot", start, end)

    def samples(self, start=None, end=None) -> DataFrame:
        samples = unnest_series(self._events) if self._samples is None else self._samples
        return in_range(samples, "slot", start, end)

    def predicts(self, start=None, end=None) -> DataFrame:
        return in_range(self._predicts, "slot", start, end)

    def cameras(self) -> DataFrame:
        return F.broadcast(self._cameras) if self._small_cameras else self._cameras

    def metrics(self, names=None, start=None, end=None) -> DataFrame:
        samples = in_range(self._metrics, "ts", start, end)
        return samples if names is None else samples.where(F.col("metric").isin(*names))
