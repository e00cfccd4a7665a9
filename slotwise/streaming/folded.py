"""Append streams whose files stay few and large.

A batch appends a run, a folder of its rows by day. Small neighbouring runs are folded into
one, level by level as in a counter of base ``fan``, until a run has the target size and is
left alone: a row is written again once per level at most, and what a batch does does not
depend on what was written before. A run's folder is named by its first and last batch and
counts once its ``_SUCCESS`` is there; readers take the runs that no other one covers, so
each row is read once at any time. Covered runs stay until a later batch folds, for readers
that have begun.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from slotwise.streaming.slots import _bytes, _each_batch, _folder

#: Runs of one level that become one of the next.
FAN = 8
#: Bytes from which on a run is left alone; its files have Spark's advisory size.
TARGET = 1 << 30


class Run(NamedTuple):
    first: int
    last: int

    @property
    def folder(self) -> str:
        return f"run={self.first}-{self.last}"

    def covers(self, other: Run) -> bool:
        return self != other and self.first <= other.first and other.last <= self.last


def append_folded(
    rows: DataFrame, path: str, checkpoint: str, time_column: str = "slot", once: bool = False, fan: int = FAN, target: int = TARGET
) -> StreamingQuery:
    """Append to Parquet by day, each batch once; read it with :func:`read_folded`.

    A batch that runs again finds its run, or the one it was folded into, and adds nothing.
    A fold that was stopped left no ``_SUCCESS`` and is done anew. One query per ``path``.
    """
    schema = T.StructType([*rows.schema.fields])
    sizes: dict[Run, int] = {}
    covered: list[Run] = []

    def load(spark: SparkSession) -> None:
        found = finished(spark, path)
        shown = uncovered(found)
        sizes.update((run, _bytes(spark, f"{path}/{run.folder}")) for run in shown)
        covered.extend(set(found) - set(shown))

    def keep(spark: SparkSession, run: Run, out: DataFrame) -> None:
        (
            out.withColumn("dt", F.to_date(time_column)).hint("rebalance", F.col("dt"))
            .write.mode("overwrite").partitionBy("dt").parquet(f"{path}/{run.folder}")
        )
        sizes[run] = _bytes(spark, f"{path}/{run.folder}")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if not sizes:
            load(spark)
        if not any(run.first <= batch_id <= run.last for run in sizes):
            keep(spark, Run(batch_id, batch_id), batch)
        replaced: list[Run] = []
        while merged := foldable(sizes, fan, target):
            whole = Run(merged[0].first, merged[-1].last)
            keep(spark, whole, _rows(spark, path, merged, schema))
            for run in merged:
                del sizes[run]
            replaced += merged
        if replaced:
            for run in covered:
                files, folder = _folder(spark, f"{path}/{run.folder}")
                files.delete(folder, True)
            covered[:] = replaced

    return _each_batch(rows, write, checkpoint, once)


def foldable(sizes: dict[Run, int], fan: int, target: int) -> list[Run]:
    """The neighbouring runs to fold next, of at least two; none is of the target size.

    The newest runs fold when ``fan`` of them are of one level, or together reach the
    target; older ones when a run of the target size follows, as nothing else will join them.
    """
    tail: list[Run] = []
    for run in sorted(sizes):
        if sizes[run] < target:
            tail.append(run)
        elif len(tail) > 1:
            return tail
        else:
            tail = []
    if len(tail) > 1 and sum(sizes[run] for run in tail) >= target:
        return tail
    same = [run for run in tail if _level(run, fan) == _level(tail[-1], fan)]
    return tail[-len(same):] if len(same) >= fan else []


def _level(run: Run, fan: int) -> int:
    level, batches = 0, run.last - run.first + 1
    while batches >= fan:
        level, batches = level + 1, batches // fan
    return level


def finished(spark: SparkSession, path: str) -> list[Run]:
    """The runs under a path that were written to their end."""
    files, marks = _folder(spark, f"{path}/run=*/_SUCCESS")
    names = [status.getPath().getParent().getName() for status in files.globStatus(marks) or []]
    return sorted(Run(*map(int, name[4:].split("-"))) for name in names)


def uncovered(runs: list[Run]) -> list[Run]:
    """The runs that lie in no other: in the order of their first batch, the longest first,
    those that reach further than all before."""
    shown: list[Run] = []
    for run in sorted(runs, key=lambda r: (r.first, -r.last)):
        if not shown or run.last > shown[-1].last:
            shown.append(run)
    return shown


def read_folded(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What :func:`append_folded` wrote, each row once, with its day as ``dt``."""
    return _rows(spark, path, uncovered(finished(spark, path)), schema)


def _rows(spark: SparkSession, path: str, runs: list[Run], schema: T.StructType) -> DataFrame:
    whole = T.StructType([*schema.fields, T.StructField("dt", T.DateType())])
    if not runs:
        return spark.createDataFrame([], whole)
    reader = spark.read.schema(whole).option("basePath", path)
    return reader.parquet(*[f"{path}/{run.folder}" for run in runs]).select(*whole.fieldNames())
