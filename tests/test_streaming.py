import json

import pytest
from helpers import at, dicts
from pyspark.sql import functions as F

from slotwise import schemas
from slotwise.operators import slots as batch
from slotwise.operators.series import counter_rate
from slotwise.streaming import slots as stream

FEED = "camera_id string, ts string, kind string, speed double, temp double"


def write(folder, name, rows):
    folder.mkdir(exist_ok=True)
    keys = ("camera_id", "ts", "kind", "speed", "temp")
    (folder / name).write_text("\n".join(json.dumps(dict(zip(keys, r))) for r in rows))


def feeds(spark, folder):
    raw = stream.file_records(spark, str(folder), schemas.T.StructType.fromDDL(FEED), per_trigger=1)
    temp = F.to_json(F.struct(F.struct("temp").alias("main")))
    doc = F.when(F.col("kind") == "weather", F.from_json(temp, schemas.WEATHER_DOC))
    return raw.select("camera_id", F.col("ts").cast("timestamp").alias("ts"), "kind", "speed", doc.alias("doc"))


def drain(rows, root):
    stream.append_days(rows, f"{root}/out", f"{root}/ck", once=True).awaitTermination()


def read(spark, root):
    return spark.read.parquet(f"{root}/out").drop("dt")


def test_late_records_are_dropped_and_the_last_weather_wins(spark, tmp_path):
    write(tmp_path / "in", "1.json", [
        ("a", "2024-01-01 00:00:10", "speed", 10.0, None),
        ("a", "2024-01-01 00:01:00", "weather", None, 31.0),
        ("a", "2024-01-01 00:02:00", "weather", None, 29.0),
        ("a", "2024-01-01 00:03:00", "frame", None, None),
        ("b", "2024-01-01 00:04:00", "speed", 40.0, None),
    ])
    drain(stream.stream_slot_rows(feeds(spark, tmp_path / "in"), local=False), tmp_path)
    # On time for slot 00:00 (watermark 23:59), then the watermark moves to 00:25.
    write(tmp_path / "in", "2.json", [("a", "2024-01-01 00:04:59", "speed", 30.0, None)])
    drain(stream.stream_slot_rows(feeds(spark, tmp_path / "in"), local=False), tmp_path)
    write(tmp_path / "in", "3.json", [("a", "2024-01-01 00:30:00", "speed", 50.0, None)])
    drain(stream.stream_slot_rows(feeds(spark, tmp_path / "in"), local=False), tmp_path)
    # Too late for slot 00:00.
    write(tmp_path / "in", "4.json", [("a", "2024-01-01 00:00:20", "speed", 99.0, None), ("a", "2024-01-01 00:50:00", "frame", None, None)])
    drain(stream.stream_slot_rows(feeds(spark, tmp_path / "in"), local=False), tmp_path)
    rows = {(r["camera_id"], r["slot"]): r for r in dicts(read(spark, tmp_path))}
    first = rows[("a", at("2024-01-01 00:00:00"))]
    assert (first["speed_count"], first["speed_avg_kmh"], first["completeness"]) == (2, 20.0, 100)
    assert first["weather"]["temp"] == 29.0
    assert rows[("b", at("2024-01-01 00:00:00"))]["completeness"] == 33
    # 00:30 is closed, 00:50 is still open.
    assert set(rows) == {("a", at("2024-01-01 00:00:00")), ("b", at("2024-01-01 00:00:00")), ("a", at("2024-01-01 00:30:00"))}


def test_stream_equals_batch_for_closed_slots(spark, tmp_path):
    rows = [(f"c{i % 3}", str(at("2024-01-01 00:00:00").replace(minute=i // 2, second=i % 60)), "speed", float(i), None) for i in range(100)]
    write(tmp_path / "in", "1.json", rows)
    drain(stream.stream_speed_slots(feeds(spark, tmp_path / "in").drop("doc"), local=False), tmp_path)
    samples = spark.createDataFrame(rows, FEED).select(
        "camera_id", F.window(F.col("ts").cast("timestamp"), "5 minutes").start.cast("timestamp_ntz").alias("slot"), "speed")
    newest = max(r[1] for r in rows)
    closed = F.col("slot") + F.expr("INTERVAL 10 MINUTES") <= F.lit(newest).cast("timestamp_ntz")
    want = {(r["camera_id"], r["slot"]): (r["count"], r["avg_kmh"]) for r in dicts(batch.slot_speed_stats(samples).where(closed))}
    got = {(r["camera_id"], r["slot"]): (r["speed_count"], r["speed_avg_kmh"]) for r in dicts(read(spark, tmp_path))}
    assert want and got == want


def test_latest_record_per_camera_over_batches(spark, tmp_path):
    for name, text in (("1.json", "2024-01-01 00:10:00"), ("2.json", "2024-01-01 00:05:00")):
        write(tmp_path / "in", name, [("a", text, "frame", None, None), ("b" + name[0], text, "frame", None, None)])
        live = stream.file_records(spark, str(tmp_path / "in"), schemas.T.StructType.fromDDL(FEED), per_trigger=1)
        stream.keep_latest(live, f"{tmp_path}/out", f"{tmp_path}/ck", once=True).awaitTermination()
    rows = {r["camera_id"]: r["ts"] for r in dicts(stream.read_latest(spark, f"{tmp_path}/out", live.schema))}
    assert rows == {"a": "2024-01-01 00:10:00", "b1": "2024-01-01 00:10:00", "b2": "2024-01-01 00:05:00"}


def test_rejects_go_aside(spark, tmp_path):
    write(tmp_path / "in", "1.json", [("a", "t", "frame", None, None), (" ", "t", "frame", None, None), (None, "t", "frame", None, None)])
    live = stream.file_records(spark, str(tmp_path / "in"), schemas.T.StructType.fromDDL(FEED))
    stream.split_rejects(live, f"{tmp_path}/out", f"{tmp_path}/ck", once=True).awaitTermination()
    counts = {r["route"]: r["n"] for r in dicts(spark.read.parquet(f"{tmp_path}/out").groupBy("route").agg(F.count("*").alias("n")))}
    assert counts == {"accepted": 1, "rejected": 2}


def test_sliding_rate_with_a_restart(spark, tmp_path):
    write(tmp_path / "in", "1.json", [
        ("s", "2024-01-01 00:00:00", "m", 10.0, None), ("s", "2024-01-01 00:03:00", "m", 20.0, None),
        ("s", "2024-01-01 00:06:00", "m", 5.0, None), ("s", "2024-01-01 01:00:00", "m", 6.0, None)])
    live = stream.file_records(spark, str(tmp_path / "in"), schemas.T.StructType.fromDDL(FEED)).select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("kind").alias("metric"), F.col("camera_id").alias("series"), F.col("speed").alias("value"))
    rates = stream.stream_rate(live, "10 minutes", "5 minutes")
    stream.append_days(rates, f"{tmp_path}/out", f"{tmp_path}/ck", "window_start", once=True).awaitTermination()
    got = {(r["window_start"], r["samples"], r["rate"] * 600) for r in dicts(read(spark, tmp_path))}
    assert got == {(at("2023-12-31 23:55:00"), 2, 10.0), (at("2024-01-01 00:00:00"), 3, 15.0)}


@pytest.mark.parametrize("zone", ["UTC", "Asia/Ho_Chi_Minh", "America/New_York"])
def test_slot_labels_are_local_in_any_session_zone(spark, tmp_path, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        dates = ["Tue, 18 Nov 2025 17:03:21 GMT", "Tue, 18 Nov 2025 18:00:00 GMT"]
        (tmp_path / "in").mkdir()
        (tmp_path / "in" / "1.json").write_text("\n".join(json.dumps({"camera_id": "a", "date": d, "speed": 4.0}) for d in dates))
        live = stream.file_records(spark, str(tmp_path / "in"), schemas.T.StructType.fromDDL("camera_id string, date string, speed double"))
        live = stream.event_time(live.withColumn("ts", F.current_timestamp()), F.col("date"))
        drain(stream.stream_speed_slots(live), tmp_path)
        slots = {str(r["slot"]) for r in dicts(read(spark, tmp_path))}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert slots == {"2025-11-19 00:00:00"}


@pytest.mark.parametrize("values", [[100.0, 120.0, 0.0, 200.0], [5.0, 9.0, 2.0, 4.0, 1.0, 8.0], [3.0, 3.0, 0.0, 0.0, 7.0]])
def test_streamed_rate_is_the_batch_rate(spark, tmp_path, values):
    """Any number of restarts, in one pane and across panes."""
    rows = [("s", f"2024-01-01 00:0{k * 20 // 60}:{k * 20 % 60:02d}", "m", v, None) for k, v in enumerate(values)]
    write(tmp_path / "in", "1.json", [*rows, ("s", "2024-01-01 02:00:00", "m", 1.0, None)])
    live = stream.file_records(spark, str(tmp_path / "in"), schemas.T.StructType.fromDDL(FEED)).select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("kind").alias("metric"), F.col("camera_id").alias("series"), F.col("speed").alias("value"))
    stream.append_days(stream.stream_rate(live, "10 minutes", "5 minutes"), f"{tmp_path}/out", f"{tmp_path}/ck", "window_start", once=True).awaitTermination()
    got = {r["window_start"]: r["rate"] for r in dicts(read(spark, tmp_path))}
    samples = spark.createDataFrame([(at(t), "m", {"s": "s"}, "s", v) for _, t, _, v, _ in rows], schemas.METRICS)
    want = dicts(counter_rate(samples, 600).orderBy("ts"))[-1]["rate"]
    assert got[at("2024-01-01 00:00:00")] == pytest.approx(want)
    if values[0] == 100.0:
        assert want * 600 == pytest.approx(220.0)


def test_decode(spark):
    messages = spark.createDataFrame([(b'{"camera_id": "a", "speed": 3}', at("2024-01-01")), (b"{bad", at("2024-01-01"))], "value binary, timestamp timestamp")
    assert [r["camera_id"] for r in dicts(stream.decode(messages, schemas.RAW_SPEED))] == ["a", None]


def test_the_latest_table_is_a_log_that_is_folded(spark, tmp_path):
    """Many batches of few of many cameras: what is written follows the batch, old files go."""
    schema = schemas.T.StructType.fromDDL(FEED)
    out, folder = tmp_path / "out", tmp_path / "in"
    size = lambda kind: {f.name: sum(x.stat().st_size for x in f.glob("*.parquet")) for f in (out / kind).glob("batch=*")} if (out / kind).exists() else {}

    def run():
        live = stream.file_records(spark, str(folder), schema, per_trigger=1)
        stream.keep_latest(live, str(out), f"{tmp_path}/ck", once=True, fold_batches=4).awaitTermination()
        return {r["camera_id"]: r["speed"] for r in dicts(stream.read_latest(spark, str(out), schema))}

    write(folder, "00.json", [(f"c{k}", "2024-01-01 00:00:00", "frame", 0.0, None) for k in range(3000)])
    want = dict.fromkeys((f"c{k}" for k in range(3000)), 0.0)
    for k in range(1, 12):
        write(folder, f"{k:02d}.json", [(f"c{k}", f"2024-01-01 00:{k:02d}:00", "frame", float(k), None), (f"c{k + 1}", "2023-01-01 00:00:00", "frame", -1.0, None)])
        want[f"c{k}"] = float(k)
    assert run() == want
    # The first fold came with the fourth batch; later changes are far smaller than the base.
    assert list(size("base")) == ["batch=3"] and max(size("changes").values()) == size("changes")["batch=0"]
    assert all(n < 0.2 * size("base")["batch=3"] for name, n in size("changes").items() if name != "batch=0")
    for k in range(12, 17):
        write(folder, f"{k:02d}.json", [(f"c{j}", f"2024-01-02 00:{k:02d}:00", "frame", float(k), None) for j in range(3000)])
    assert run() == dict.fromkeys(want, 16.0)
    bases = sorted(int(n[6:]) for n in size("base"))
    assert 1 <= len(bases) <= 2 and bases[-1] >= 12
    assert min(int(n[6:]) for n in size("changes")) > 3


def test_a_batch_of_the_latest_table_that_runs_again_changes_nothing(spark, tmp_path):
    schema = schemas.T.StructType.fromDDL(FEED)
    write(tmp_path / "in", "1.json", [("a", f"2024-01-01 00:0{k}:00", "frame", float(k), None) for k in range(9)])
    seen = []
    for checkpoint in ("one", "two"):  # a lost checkpoint runs batch 0 again
        live = stream.file_records(spark, str(tmp_path / "in"), schema, per_trigger=1)
        stream.keep_latest(live, f"{tmp_path}/out", f"{tmp_path}/{checkpoint}", once=True, fold_batches=1).awaitTermination()
        seen.append(dicts(stream.read_latest(spark, f"{tmp_path}/out", schema)))
    assert seen[0] == seen[1] and seen[0][0]["speed"] == 8.0
    assert stream.read_latest(spark, f"{tmp_path}/none", schema).count() == 0


def test_weather_documents_of_one_instant(spark, tmp_path):
    for k, order in enumerate(((30.0, 31.0), (31.0, 30.0))):
        root = tmp_path / str(k)
        root.mkdir()
        write(root / "in", "1.json", [("a", "2024-01-01 00:01:00", "weather", None, t) for t in order] + [("z", "2024-01-01 01:00:00", "frame", None, None)])
        drain(stream.stream_slot_rows(feeds(spark, root / "in"), local=False), root)
        assert [r["weather"]["temp"] for r in dicts(read(spark, root)) if r["camera_id"] == "a"] == [31.0]
