"""Which run's folder holds each day of the tables that the batch job writes.

A run writes its days beside the old ones, to ``<root>/runs/<table>/run=<id>/dt=<day>``. It
becomes visible, in all tables at once, when the next version of a small pointer table is
put in place: one file that names the run of every day of every table. Readers follow the
highest version, so a job that stops at any point leaves the version before it whole.
"""

from __future__ import annotations

import json
import uuid
from datetime import date

from pyspark.sql import SparkSession

#: Versions whose days stay on disk for readers that still follow them.
KEPT = 3
_NAME = "v{:010d}.jsonl"

#: The run of each day, by table.
Days = dict[str, dict[date, str]]


def _path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _children(spark: SparkSession, path: str) -> list[str]:
    fs, target = _path(spark, path)
    return sorted(entry.getPath().getName() for entry in fs.listStatus(target)) if fs.exists(target) else []


def versions(spark: SparkSession, root: str) -> list[int]:
    names = _children(spark, f"{root}/runs/versions")
    return [int(name[1:11]) for name in names if name.startswith("v") and name.endswith(".jsonl")]


def days_of(spark: SparkSession, root: str, version: int) -> Days:
    """The pointer table of one version: a row per table and day, read by the driver."""
    days: Days = {}
    for row in spark.read.text(f"{root}/runs/versions/{_NAME.format(version)}").collect():
        entry = json.loads(row.value)
        days.setdefault(entry["table"], {})[date.fromisoformat(entry["dt"])] = entry["run"]
    return days


def current(spark: SparkSession, root: str) -> Days | None:
    """The days of the highest version; None where no run was ever committed."""
    found = versions(spark, root)
    return days_of(spark, root, found[-1]) if found else None


def new_run() -> str:
    return uuid.uuid4().hex


def written_days(spark: SparkSession, root: str, table: str, run: str) -> list[date]:
    """The days for which a run has a folder."""
    names = _children(spark, f"{root}/runs/{table}/run={run}")
    return [date.fromisoformat(name[3:]) for name in names if name.startswith("dt=") and name[3:4].isdigit()]


def commit(spark: SparkSession, root: str, run: str, tables: list[str], replaced: list[date]) -> int:
    """Make ``run`` the one that holds the ``replaced`` days in all ``tables``, and return
    the new version. A table for which the run wrote nothing on such a day is empty there.

    The file is written under another name first and renamed, which shows it whole or not at
    all. One writer per root at a time: a version that is already there is not overwritten.
    """
    found = versions(spark, root)
    days = days_of(spark, root, found[-1]) if found else {}
    for table in tables:
        written = set(written_days(spark, root, table, run))
        kept = {day: old for day, old in days.get(table, {}).items() if day not in set(replaced)}
        days[table] = kept | {day: run for day in replaced if day in written}
    number = found[-1] + 1 if found else 1
    lines = [json.dumps({"table": t, "dt": d.isoformat(), "run": r}) for t in sorted(days) for d, r in sorted(days[t].items())]
    fs, draft = _path(spark, f"{root}/runs/versions/_{run}")
    _, target = _path(spark, f"{root}/runs/versions/{_NAME.format(number)}")
    out = fs.create(draft, True)
    out.write("".join(f"{line}\n" for line in lines).encode())
    out.close()
    if fs.exists(target) or not fs.rename(draft, target):
        raise RuntimeError(f"version {number} was written by another job")
    return number


def remove_old(spark: SparkSession, root: str, kept: int = KEPT) -> list[str]:
    """Remove the days that none of the last ``kept`` versions names, those of stopped runs
    included, and the versions before these; returns what went. Not while a job writes."""
    found = versions(spark, root)
    named = {
        f"{table}/run={run}/dt={day.isoformat()}" for version in found[-kept:]
        for table, days in days_of(spark, root, version).items() for day, run in days.items()
    }
    gone = []
    for table in _children(spark, f"{root}/runs"):
        for run in _children(spark, f"{root}/runs/{table}"):
            folder = f"{table}/{run}"
            days = _children(spark, f"{root}/runs/{folder}") if run.startswith("run=") else []
            gone += [f"{folder}/{day}" for day in days if day.startswith("dt=") and f"{folder}/{day}" not in named]
    gone += [f"versions/{_NAME.format(version)}" for version in found[:-kept]]
    for name in gone:
        fs, target = _path(spark, f"{root}/runs/{name}")
        fs.delete(target, True)
    return gone
