"""Writers of the stored tables."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.operators.series import with_series

#: Rows of a day that one task sorts and writes, about, where a day is cut by its rows.
TASK_ROWS = 500_000
#: Partitions up to which Spark's shuffle writes rows straight to files and holds none in memory.
MOST_PARTITIONS = 200
#: Rows that one write shuffles, from which on the next days wait for another, and such writes
#: at most, about: each reads the input again.
WRITE_ROWS, MOST_WRITES = 50_000_000, 16


def _day_rows(df: DataFrame, time_column: str) -> dict[date | None, int]:
    """Rows per day; one pass counts them."""
    return {row.dt: row["count"] for row in df.groupBy(F.to_date(time_column).alias("dt")).count().collect()}  # a row per day


def _spans(rows: dict[date | None, int]) -> list[tuple[date | None, date | None]]:
    """Days that are written together, as half-open spans that leave no gap; the first one and
    the last one are open."""
    least = max(WRITE_ROWS, -(-sum(rows.values()) // MOST_WRITES))
    starts, held = [], rows.get(None, 0)
    for day in sorted(d for d in rows if d is not None):
        if held >= least:
            starts.append(day)
            held = 0
        held += rows[day]
    return list(zip([None, *starts], [*starts, None]))


def _in_span(df: DataFrame, time_column: str, start: date | None, end: date | None) -> DataFrame:
    """The rows of a span of days, told by bounds on the time itself, which reach a scan. Rows
    without a time go with the open start."""
    kind = df.select(time_column).schema[0].dataType
    bound = lambda day: F.lit(day).cast(kind)
    if start is not None:
        df = df.where(F.col(time_column) >= bound(start))
    if end is not None:
        before = F.col(time_column) < bound(end)
        df = df.where(before if start is not None else before | F.col(time_column).isNull())
    return df


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is run inside leaves no shuffle files behind; else they would stay until the
    driver's garbage collector finds them."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _pieces(
    df: DataFrame, time_column: str, cut: tuple[str, ...], rows: dict[date | None, int] | None = None
) -> tuple[int, Column] | None:
    """Number of partitions, and the piece of its day a row belongs to: each day with more
    than TASK_ROWS rows is cut by the hash of ``cut``. None where there is no such day.
    ``rows`` are those of the days, where they are known."""
    counts = _day_rows(df, time_column) if rows is None else rows
    wanted = {day: -(-n // TASK_ROWS) for day, n in counts.items() if day is not None}
    large = [F.lit(x) for day, n in wanted.items() if n > 1 for x in (day, n)]
    if not large:
        return None
    of_day = F.coalesce(F.try_element_at(F.create_map(*large), F.col("dt")), F.lit(1))
    # More partitions than pieces, so that few pieces meet in one; empty ones cost nothing.
    return min(MOST_PARTITIONS, 4 * sum(wanted.values())), F.pmod(F.xxhash64(*cut), of_day)


def write_days(
    df: DataFrame,
    path: str,
    time_column: str = "slot",
    sort: tuple[str, ...] = ("camera_id", "slot"),
    camera_folders: bool = False,
    cut: tuple[str, ...] = (),
) -> None:
    """Replace the days present in ``df``; other days stay, so a re-run is idempotent.

    The rebalance hint lets AQE cut a large day, or a day that one camera fills, into
    files of the advisory size and join small ones. Rows are sorted inside each file so
    that row-group statistics prune on camera. ``camera_folders`` adds a second partition
    level; use it only for few cameras, as it makes one folder per camera and day. A day is
    cut where tasks of the shuffle end; name ``cut`` columns for rows that compress so well
    that a file of the advisory size is too much for a task to sort.

    With ``cut``, a large table is written some days at a time, so that the shuffle never
    holds all of it: ``df`` is run once per span of days and must give the same rows each
    time, so it cannot read the table itself. A day is never divided between writes; if one
    fails, the days of those before it stay replaced, and a re-run replaces all.
    """
    if not cut:
        _write_span(df, path, time_column, sort, camera_folders)
        return
    with _shuffles_removed(df.sparkSession):
        rows = _day_rows(df, time_column)
        for start, end in _spans(rows):
            held = {day: n for day, n in rows.items() if day is not None and (not start or day >= start) and (not end or day < end)}
            some = _in_span(df, time_column, start, end)
            _write_span(some, path, time_column, sort, camera_folders, _pieces(some, time_column, cut, held))


def _write_span(
    df: DataFrame, path: str, time_column: str, sort: tuple[str, ...], camera_folders: bool, found: tuple[int, Column] | None = None
) -> None:
    """The days of ``df`` in one write, cut as ``found`` says."""
    parts = ["dt", "camera_id"] if camera_folders else ["dt"]
    days = df.withColumn("dt", F.to_date(time_column))
    if found:
        number, piece = found
        spread = days.withColumn("_piece", piece).hint("rebalance", number, *[F.col(c) for c in (*parts, "_piece")]).drop("_piece")
    else:
        spread = days.hint("rebalance", *[F.col(c) for c in parts])
    (
        spread.sortWithinPartitions(*dict.fromkeys((*parts, *sort)))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*parts)
        .parquet(path)
    )


def add_run(df: DataFrame, path: str, run: str, sort: tuple[str, ...] = ("camera_id", "slot")) -> None:
    """Append slots to the folder of a run, by day; no reader sees them until the run is
    committed (:mod:`slotwise.sources.versions`)."""
    (
        df.withColumns({"dt": F.to_date("slot"), "run": F.lit(run)})
        .hint("rebalance", F.col("dt"))
        .sortWithinPartitions(*dict.fromkeys(("dt", *sort)))
        .write.mode("append")
        .partitionBy("run", "dt")
        .parquet(path)
    )


def write_events(events: DataFrame, root: str, **options) -> None:
    """Slot rows without their samples, which are a table of their own."""
    write_days(events.drop("speed_series"), f"{root}/events", **options)


def write_samples(samples: DataFrame, root: str, **options) -> None:
    """Every speed sample of every slot, in long form."""
    write_days(samples, f"{root}/speed_samples", sort=("camera_id", "slot", "time"), **options)


def write_frames(frames: DataFrame, root: str, **options) -> None:
    """Every frame of every slot, in long form."""
    write_days(frames, f"{root}/frames", sort=("camera_id", "slot", "time"), **options)


def write_predicts(predicts: DataFrame, root: str, **options) -> None:
    write_days(predicts, f"{root}/predicts", **options)


def write_cameras(cameras: DataFrame, root: str) -> None:
    cameras.write.mode("overwrite").parquet(f"{root}/cameras")


def write_metrics(samples: DataFrame, root: str, **options) -> None:
    """The series key is stored with the samples, so that reports need not derive it."""
    write_days(with_series(samples), f"{root}/metrics", time_column="ts", sort=("metric", "ts"), cut=("ts", "series"), **options)


def write_slot_documents(documents: DataFrame, path: str) -> None:
    """Slot documents as JSON lines, one folder per day; other days stay."""
    (
        documents.withColumn("dt", F.to_date(F.col("slot").try_cast("timestamp_ntz")))
        .hint("rebalance", F.col("dt"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("dt")
        .json(path)
    )
