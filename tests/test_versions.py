"""The batch job's commit: a stop at any step leaves one whole version."""

from pathlib import Path

import pytest
from helpers import at, dicts
from pyspark.sql import functions as F
from test_slots import SLOT, frames_of, samples_of, weather_of

from slotwise import schemas
from slotwise.plans import ingest
from slotwise.sources import sinks, versions
from slotwise.sources.tables import StoredTables

LATE, NEXT = at("2024-01-09 00:00:00"), at("2024-01-02 00:00:00")


def feed(spark, value, slots=(SLOT, NEXT), n=3):
    return samples_of(spark, [("a", slot, f"{slot:%Y-%m-%d %H:%M}:{k:02d}", value) for slot in slots for k in range(n)])


def store(spark, tables, value, slots=(SLOT, NEXT), n=3, **more):
    frames = frames_of(spark, [("a", slot, "t", f"s3://b/{value}") for slot in slots])
    return ingest.store_slots(frames, feed(spark, value, slots, n), weather_of(spark, ["a"]).where(F.lit(SLOT in slots)), tables, LATE, **more)


def seen(tables, *span):
    """What a reader gets of the three tables."""
    events = sorted((r["slot"].day, r["speed_count"], r["speed_avg_kmh"], len(r["speed_series"])) for r in dicts(tables.events(*span, series=True)))
    return events, tables.samples(*span).agg(F.count("speed"), F.sum("speed")).first()[:], sorted(r["image_ref"] for r in dicts(tables.frames(*span)))


WHOLE = ([(1, 3, 1.0, 3), (2, 3, 1.0, 3)], (6, 6.0), ["s3://b/1.0"] * 2)


@pytest.mark.parametrize("step", ["add_run:1", "add_run:2", "add_run:3", "commit", "rename"])
def test_a_stopped_job_changes_nothing(spark, tmp_path, monkeypatch, step):
    tables = StoredTables(spark, str(tmp_path / "t"))
    store(spark, tables, 1.0)
    assert seen(tables) == WHOLE
    name, _, number = step.partition(":")
    calls = []
    if name == "add_run":
        real = sinks.add_run

        def stopping(*args, **kwargs):
            calls.append(1)
            if len(calls) == int(number):
                raise KeyboardInterrupt
            real(*args, **kwargs)

        monkeypatch.setattr(sinks, "add_run", stopping)
    elif name == "commit":
        monkeypatch.setattr(versions, "commit", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
    else:  # the draft of the pointer table is there, but has not its name yet
        monkeypatch.setattr(versions, "_NAME", "draft{:010d}")
        real_versions = versions.versions(spark, tables.root)
        monkeypatch.setattr(versions, "versions", lambda *_: [])
        store(spark, tables, 5.0)
        monkeypatch.undo()
        assert versions.versions(spark, tables.root) == real_versions
    if name != "rename":
        with pytest.raises(KeyboardInterrupt):
            store(spark, tables, 2.0)
        monkeypatch.undo()
    assert seen(tables) == WHOLE
    store(spark, tables, 3.0, n=2)
    assert seen(tables) == ([(1, 2, 3.0, 2), (2, 2, 3.0, 2)], (4, 12.0), ["s3://b/3.0"] * 2)


def test_days_without_records_are_empty_in_the_new_version(spark, tmp_path):
    tables = StoredTables(spark, str(tmp_path / "t"))
    store(spark, tables, 1.0)
    none = frames_of(spark, [])
    assert ingest.store_slots(none, feed(spark, 4.0, (SLOT,), 1), weather_of(spark, []), tables, LATE) == 2
    assert seen(tables) == ([(1, 1, 4.0, 1), (2, 3, 1.0, 3)], (4, 7.0), ["s3://b/1.0"])
    assert ingest.store_slots(none, feed(spark, 4.0, ()), weather_of(spark, []), tables, LATE) is None
    assert versions.versions(spark, tables.root) == [1, 2]


def test_a_running_reader_keeps_its_version_until_it_is_removed(spark, tmp_path):
    tables = StoredTables(spark, str(tmp_path / "t"))
    store(spark, tables, 1.0)
    reading = tables.samples()
    for value in (2.0, 3.0, 4.0):
        store(spark, tables, value, (SLOT,))
    assert reading.agg(F.sum("speed")).first()[0] == 6.0
    with pytest.raises(KeyboardInterrupt), pytest.MonkeyPatch.context() as patch:
        patch.setattr(versions, "commit", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
        store(spark, tables, 9.0)
    before = seen(tables)
    gone = versions.remove_old(spark, tables.root, kept=1)
    # Three runs of the first day, the stopped run's two days in three tables, three versions.
    assert len([g for g in gone if g.startswith("versions")]) == 3 and len(gone) == 3 + 3 * 3 + 3 * 2
    assert seen(tables) == before == ([(1, 3, 4.0, 3), (2, 3, 1.0, 3)], (6, 15.0), ["s3://b/1.0", "s3://b/4.0"])
    assert versions.remove_old(spark, tables.root, kept=1) == []


def test_feeds_may_come_from_the_tables_themselves(spark, tmp_path):
    tables = StoredTables(spark, str(tmp_path / "t"))
    store(spark, tables, 1.0)
    samples = tables.samples().withColumn("time", F.col("time").cast("string"))
    for whole in (True, False):
        ingest.store_slots(tables.frames(), samples, weather_of(spark, ["a"]), tables, LATE, whole)
        assert seen(tables) == WHOLE


def test_other_days_of_the_plain_tables_stay(spark, tmp_path):
    tables = StoredTables(spark, str(tmp_path / "t"))
    old = spark.createDataFrame(
        [("a", slot, slot, 300, 0.0, 1, v, v, v, None, None) for slot, v in ((SLOT, 7.0), (NEXT, 8.0), (LATE, 9.0))], schemas.EVENTS
    )
    sinks.write_events(old, tables.root)
    store(spark, tables, 1.0, (SLOT,))
    assert sorted((r["slot"].day, r["speed_avg_kmh"]) for r in dicts(tables.events())) == [(1, 1.0), (2, 8.0), (9, 9.0)]


def test_readers_open_only_the_folders_of_their_range(spark, tmp_path):
    tables = StoredTables(spark, str(tmp_path / "t"))
    store(spark, tables, 1.0)
    store(spark, tables, 2.0)
    assert seen(tables, NEXT, LATE) == ([(2, 3, 2.0, 3)], (3, 6.0), ["s3://b/2.0"])
    files = [Path(f) for f in tables.samples(NEXT, LATE).inputFiles()]
    assert files and all("dt=2024-01-02" in str(f) for f in files)
    assert len({f.parent.parent.name for f in files}) == 1
    assert tables.samples(LATE).count() == 0


def test_two_writers_do_not_overwrite_each_other(spark, tmp_path, monkeypatch):
    tables = StoredTables(spark, str(tmp_path / "t"))
    store(spark, tables, 1.0)
    monkeypatch.setattr(versions, "versions", lambda *_: [])  # the other job's version came after this one looked
    with pytest.raises(RuntimeError):
        store(spark, tables, 2.0)
    monkeypatch.undo()
    assert seen(tables) == WHOLE
