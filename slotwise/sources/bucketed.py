"""Slot facts stored in buckets, so that fact meets fact without a shuffle.

Events and forecasts are cut into the same number of buckets by the hash of camera and slot,
inside each day. A join on both then reads bucket by bucket. The files are plain Parquet
under the root; the tables are entries in the session's catalog, made anew from the files
by any session that opens the same root.
"""

from __future__ import annotations

import hashlib
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise import schemas
from slotwise.operators.slots import KEYS
from slotwise.session import path_exists
from slotwise.sources.tables import StoredTables, scan_days

#: Buckets of a day. Joined tables must have the same number.
BUCKETS = 32
_SCHEMAS = {"events": schemas.EVENTS, "predicts": schemas.PREDICTS}


class BucketedTables(StoredTables):
    """Stored tables of which events and predicts are bucketed under ``<root>/bucketed``."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        super().__init__(spark, root)
        self.buckets = buckets

    def _path(self, name: str) -> str:
        return f"{self.root}/bucketed/{name}"

    def _table(self, name: str) -> str:
        """The catalog's name of a table, which is made where it is not known yet."""
        known = f"slotwise_{hashlib.md5(self.root.encode(), usedforsecurity=False).hexdigest()}_{name}_{self.buckets}"
        if not self.spark.catalog.tableExists(known):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in _SCHEMAS[name].fields if f.name != "speed_series")
            keys = ", ".join(KEYS)
            filled = path_exists(self.spark, self._path(name))
            self.spark.sql(f"""
                CREATE TABLE IF NOT EXISTS {known} ({columns}, dt DATE) USING parquet
                OPTIONS (partitionOverwriteMode 'dynamic') PARTITIONED BY (dt)
                CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {self.buckets} BUCKETS LOCATION '{self._path(name)}'""")
            if filled:
                self.spark.sql(f"MSCK REPAIR TABLE {known}")
        return known

    def write(self, name: str, rows: DataFrame) -> None:
        """Replace the days present in ``rows``; other days stay. One file per day and bucket."""
        wanted = [f.name for f in _SCHEMAS[name].fields if f.name != "speed_series"]
        placed = rows.select(*wanted, F.to_date("slot").alias("dt")).repartition(self.buckets, *KEYS)
        placed.sortWithinPartitions("dt", *KEYS).write.insertInto(self._table(name), overwrite=True)

    def _fact(self, name: str, schema, column: str, start: datetime | None, end: datetime | None) -> DataFrame:
        if name not in _SCHEMAS:
            return super()._fact(name, schema, column, start, end)
        rows = scan_days(self.spark.table(self._table(name)), column, start, end).drop("dt")
        series = F.lit(None).cast(schemas.SERIES).alias("speed_series")
        return rows.select(*[series if f.name == "speed_series" else f.name for f in schema.fields])

    def exists(self) -> bool:
        return path_exists(self.spark, self._path("events"))
