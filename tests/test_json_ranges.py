"""Large arrays read in ranges, against Python's JSON reader."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from slotwise import schemas
from slotwise.operators import slots
from slotwise.sources import json_feed, json_ranges


@pytest.fixture
def small_ranges(spark):
    names = {"spark.sql.files.maxPartitionBytes": "100", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name in names:
        spark.conf.unset(name)


def value(draw, depth=0):
    kind = draw.randint(0, 6 if depth < 3 else 3)
    if kind <= 3:
        return draw.choice([1, 2.5, None, True, "plain", "a } b", "},{", '"quoted" {', "back\\slash\\", "é漢😀", "", "\\\"}", "line\nbreak", "[{"])
    if kind == 4:
        return [value(draw, depth + 1) for _ in range(draw.randint(0, 3))]
    return {f"k{k}": value(draw, depth + 1) for k in range(draw.randint(0, 3))}


def texts(records):
    return sorted(json.dumps(r, sort_keys=True) for r in records)


@pytest.mark.parametrize("layout", [{}, {"indent": 2}, {"separators": (",", ":")}, {"ensure_ascii": False}])
def test_records_of_split_arrays(spark, tmp_path, small_ranges, layout):
    draw = random.Random(str(layout))
    files = {f"f{k}.json": [{"n": j, "v": value(draw)} for j in range(draw.randint(0, 40))] for k in range(6)}
    files["empty.json"], files["giant.json"] = [], [{"text": "} {\" " * 300}, {"n": 1}, {"deep": [{"x": [{"y": {}}]}] * 30}]
    for name, records in files.items():
        (tmp_path / name).write_text(json.dumps(records, **layout), encoding="utf-8")
    (tmp_path / "object.json").write_text(json.dumps({"only": {"one": 1}}))
    found = json_ranges.array_records(spark, str(tmp_path), "*.json", 0).collect()
    assert all(r.whole for r in found)
    by = {}
    for r in found:
        by.setdefault(r.path.rsplit("/", 1)[1], []).append(json.loads(r.record))
    for name, records in {**files, "object.json": [{"only": {"one": 1}}]}.items():
        assert texts(by.get(name, [])) == texts(records), name


def test_what_is_cut_off_is_no_record(spark, tmp_path, small_ranges):
    files = {
        "cut.json": '[{"a": 1}, {"a": 2', "mark.json": "﻿" + '[{"a": 1}, {"a": 2}', "open.json": '[{"a": 1}, {"b": "x', "none.json": "not json",
        "junk.json": '[{"a": 1}, junk {"a": 2}]', "end.json": '{"a": 1}', "bad.json": '[{"a": 1}, {"a": }, {"a": 3}]',
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    found = {}
    for r in json_ranges.array_records(spark, str(tmp_path), "*.json", 0).collect():
        found.setdefault(r.path.rsplit("/", 1)[1], []).append((r.record, r.whole))
    assert sorted(found["cut.json"]) == [('{"a": 1}', True), ('{"a": 2', False)]
    assert sorted(found["mark.json"]) == [('{"a": 1}', True), ('{"a": 2}', True)]
    assert sorted(found["open.json"]) == [('{"a": 1}', True), ('{"b": "x', False)]
    assert found["none.json"] == [("not json", False)] and found["end.json"] == [('{"a": 1}', True)]
    assert ('junk {"a": 2}', True) in found["junk.json"] and len(found["bad.json"]) == 3


def test_both_readers_give_the_same_rows(spark, tmp_path, small_ranges):
    rows = [{"camera_id": f"c{k % 7}", "slot": "2024-01-01T00:00:00", "time": f"t}}{k}", "speed": [k, str(k), {"x": k}, None][k % 4]} for k in range(200)]
    (tmp_path / "a.json").write_text(json.dumps(rows, indent=1))
    (tmp_path / "b.json").write_text(json.dumps(rows[:3]))
    (tmp_path / "c.json").write_text('[{"camera_id": "x"}, {"camera_id": }, {"camera_id": "y"}]')
    plain = json_feed.read_json(spark, str(tmp_path), schemas.RAW_SPEED, "[ab].json")
    split = json_feed.read_json(spark, str(tmp_path), schemas.RAW_SPEED, "[ab].json", split_above=0)
    assert split.schema.fieldNames() == plain.schema.fieldNames()

    def rows_of(df):
        # An object in a text field is kept as text; its blanks are the reader's choice.
        return sorted(re.sub(r"\s|\\n", "", str(r)) for r in df.collect())

    assert rows_of(split) == rows_of(plain) and plain.count() == 203
    assert json_ranges._pieces(spark, str(tmp_path), "a.json", 0).rdd.getNumPartitions() > 50
    # A broken record costs itself where files are split, and its file is named.
    assert {r.camera_id for r in json_feed.read_json(spark, str(tmp_path), schemas.RAW_SPEED, "c.json", split_above=0).collect()} == {"x", "y"}
    for limit in (0, 1 << 20):
        lost = json_feed.unreadable_files(spark, str(tmp_path), schemas.RAW_SPEED, "*.json", limit).collect()
        assert [r.path.rsplit("/", 1)[1] for r in lost] == ["c.json"]


def test_windows_hold_a_range_or_one_row_per_range(spark, tmp_path):
    (tmp_path / "a.json").write_text("[]")
    plan = json_ranges.array_records(spark, str(tmp_path), "*.json", 0)._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"Window \[.*?\], \[(path#\d+)(, start#\d+L)?\]", plan)
    assert keys and sum(1 for _, start in keys if start) >= 3
    # Windows over a file alone come after one row per range is left.
    for part in re.split(r"(?=Window \[)", plan):
        if re.match(r"Window \[.*?\], \[path#\d+\](?:,|\])", part):
            assert "HashAggregate" in plan[plan.index(part):]
    assert "Python" not in plan


def test_strings_are_cut_before_the_windows(spark, tmp_path):
    (tmp_path / "a.json").write_text("[]")
    plan = json_ranges.array_records(spark, str(tmp_path), "*.json", 0)._jdf.queryExecution().optimizedPlan().toString()
    below = [part.split("Relation")[0] for part in plan.split('"[^"]')[1:]]
    assert below and not any("Window" in part for part in below)


def test_a_record_is_parsed_once(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"camera_id": f"c{k}", "slot": "2024-01-01T00:00:00", "time": "t", "speed": k} for k in range(9)]))
    records = json_feed.read_json(spark, str(tmp_path), schemas.RAW_SPEED, split_above=0)
    used = slots.clean_speed(records.withColumn("slot", F.col("slot").try_cast("timestamp_ntz"))).where("slot > '2023-01-01' AND speed < 7")
    plan = used._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1 and used.count() == 7


def test_numbers_of_a_whole_file_are_not_read_again(spark, tmp_path):
    """A file is read in one go, whatever its leaves; numbers keep their text."""
    texts_of = ["1e2", "1.50", "-0", "12.3400000000000000000000001", "true", '{"x" : 1.0}', "[1, 2.50]"]
    path = tmp_path / "a.json"
    path.write_text("[" + ",\n".join(f'{{"camera_id": "c{k}", "speed": {texts_of[k % 7]}}}' for k in range(2100)) + "]")

    def bytes_read():
        return sum(s.getBytesRead() for s in spark._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics() if s.getScheme() == "file")

    before = bytes_read()
    found = {r.camera_id: r.speed for r in json_feed.read_json(spark, str(tmp_path), schemas.RAW_SPEED).collect()}
    assert found == {f"c{k}": texts_of[k % 7] for k in range(2100)}
    assert bytes_read() - before < 20 * path.stat().st_size


def test_a_file_in_another_encoding_is_named(spark, tmp_path):
    for name, encoding in {"a": "utf-16", "b": "utf-16-le", "c": "utf-16-be", "d": "utf-32"}.items():
        (tmp_path / f"{name}.json").write_bytes('[{"camera_id": "x", "speed": 1.5}]'.encode(encoding))
    (tmp_path / "e.json").write_bytes('\ufeff[{"camera_id": "x", "speed": 1.50}]'.encode())
    assert [(r.camera_id, r.speed) for r in json_feed.read_json(spark, str(tmp_path), schemas.RAW_SPEED).collect()] == [("x", "1.50")]
    lost = json_feed.unreadable_files(spark, str(tmp_path), schemas.RAW_SPEED).collect()
    assert sorted(r.path.rsplit("/", 1)[1] for r in lost) == ["a.json", "b.json", "c.json", "d.json"]
