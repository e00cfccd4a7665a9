import json
import random
import shutil

import pytest
from helpers import dicts
from pyspark.sql import types as T

from slotwise.streaming import folded
from slotwise.streaming import slots as stream
from slotwise.streaming.folded import Run

SCHEMA = T.StructType([
    T.StructField("camera_id", T.StringType()), T.StructField("slot", T.TimestampNTZType()), T.StructField("speed", T.DoubleType()),
])


def write(folder, batches, start=0):
    folder.mkdir(exist_ok=True)
    for k in range(start, start + batches):
        lines = [{"camera_id": f"c{j}", "slot": f"2024-01-0{1 + (k + j) % 2} 00:00:00", "speed": k + j / 10} for j in range(20)]
        (folder / f"{k:03d}.json").write_text("\n".join(map(json.dumps, lines)))


def drain(spark, root, checkpoint="ck", **options):
    live = stream.file_records(spark, str(root / "in"), SCHEMA, per_trigger=1)
    folded.append_folded(live, str(root / "out"), str(root / checkpoint), once=True, **options).awaitTermination()
    return live


def rows(df):
    return sorted((r["camera_id"], str(r["slot"]), r["speed"]) for r in dicts(df))


def test_fifty_batches_end_in_few_files(spark, tmp_path):
    write(tmp_path / "in", 50)
    drain(spark, tmp_path, fan=4)
    want = rows(spark.read.schema(SCHEMA).json(str(tmp_path / "in")))
    assert rows(folded.read_folded(spark, str(tmp_path / "out"), SCHEMA)) == want and len(want) == 1000
    shown = folded.uncovered(folded.finished(spark, str(tmp_path / "out")))
    # 50 is 302 to the base of four: three runs of sixteen and two of one.
    assert [r.last - r.first + 1 for r in shown] == [16, 16, 16, 1, 1]
    files = {r: len(list((tmp_path / "out" / r.folder).glob("dt=*/*.parquet"))) for r in shown}
    assert all(n <= 2 for n in files.values())
    # What batches before the last that folded had covered is gone: of batch 47, eight runs are left.
    assert len(folded.finished(spark, str(tmp_path / "out"))) == len(shown) + 8
    days = folded.read_folded(spark, str(tmp_path / "out"), SCHEMA).where("dt = DATE'2024-01-02'")
    assert days.count() == 500


def test_a_lost_checkpoint_and_a_stopped_fold_change_nothing(spark, tmp_path):
    write(tmp_path / "in", 6)
    drain(spark, tmp_path, fan=3)
    want = rows(spark.read.schema(SCHEMA).json(str(tmp_path / "in")))
    drain(spark, tmp_path, "another", fan=3)
    assert rows(folded.read_folded(spark, str(tmp_path / "out"), SCHEMA)) == want
    # A fold that stopped before its end: its files are there, its mark is not.
    out = tmp_path / "out"
    assert folded.uncovered(folded.finished(spark, str(out))) == [Run(0, 2), Run(3, 5)]
    shutil.copytree(out / "run=0-2", out / "run=0-8")
    (out / "run=0-8" / "_SUCCESS").unlink()
    assert rows(folded.read_folded(spark, str(out), SCHEMA)) == want
    write(tmp_path / "in", 3, 6)
    drain(spark, tmp_path, fan=3)
    want = rows(spark.read.schema(SCHEMA).json(str(tmp_path / "in")))
    assert rows(folded.read_folded(spark, str(out), SCHEMA)) == want
    assert folded.uncovered(folded.finished(spark, str(out))) == [Run(0, 8)]


def test_nothing_written_yet(spark, tmp_path):
    assert folded.read_folded(spark, str(tmp_path / "none"), SCHEMA).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_runs_are_few_and_rows_are_written_few_times(seed):
    """Batches of any size: folding ends, covers each batch once, and leaves no row of small runs behind."""
    draw, fan, target = random.Random(seed), 4, 1000
    sizes, written, total = {}, 0, 0
    for k in range(300):
        size = draw.choice([0, 1, 30, 400, 1500])
        sizes[Run(k, k)] = size
        total += size
        while merged := folded.foldable(sizes, fan, target):
            assert len(merged) > 1 and all(sizes[r] < target for r in merged)
            assert all(a.last + 1 == b.first for a, b in zip(merged, merged[1:]))
            size = sum(sizes.pop(r) for r in merged)
            sizes[Run(merged[0].first, merged[-1].last)] = size
            written += size
        assert sum(sizes.values()) == total
        runs = sorted(sizes)
        assert runs[0].first == 0 and all(a.last + 1 == b.first for a, b in zip(runs, runs[1:]))
    small = [r for r in runs if sizes[r] < target]
    assert written <= 5 * total and not any(a.last + 1 == b.first and sizes[b] >= target and a in small and c in small
                                            for c, a, b in zip(runs, runs[1:], runs[2:]))
