import json

from helpers import dicts
from pyspark.sql import functions as F

from slotwise import schemas
from slotwise.operators import late
from slotwise.sources import json_feed
from slotwise.streaming import slots as stream


def put(root, name, content):
    target = root / name
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(content)


def speed(camera, value):
    return json.dumps({"camera_id": camera, "timestamp": "2024-01-01T00:00:00", "speed": value})


def test_each_object_is_noted_once(spark, tmp_path):
    tree, index = tmp_path / "tree", str(tmp_path / "index")
    tree.mkdir()

    def run():
        query = json_feed.note_new(spark, str(tree), index)
        query.awaitTermination()
        return sum(p["numInputRows"] for p in query.recentProgress)

    assert run() == 0 and json_feed.noted(spark, index).count() == 0
    put(tree, "2024/01/b.json", speed("b", 1))
    put(tree, "2024/01/a.JSON", "[]")
    put(tree, "2024/notes.txt", "no object")
    assert run() == 2
    assert run() == 0
    put(tree, "2024/02/c.json", "{broken")
    assert run() == 1
    rows = dicts(json_feed.noted(spark, index))
    assert [(r["path"].split("/")[-1], r["length"]) for r in rows] == [("a.JSON", 2), ("b.json", len(speed("b", 1))), ("c.json", 7)]
    whole = dicts(json_feed.list_json(spark, str(tree)))
    assert [r["length"] for r in whole] == [r["length"] for r in rows]


def test_an_older_newcomer_is_noted(spark, tmp_path):
    import os

    index = str(tmp_path / "index")
    for name, stamp in (("new.json", 1_700_000_000), ("old.json", 1_000_000_000)):
        put(tmp_path / "tree", name, "[]")
        os.utime(tmp_path / "tree" / name, (stamp, stamp))
        json_feed.note_new(spark, str(tmp_path / "tree"), index).awaitTermination()
    assert json_feed.noted(spark, index).count() == 2


def test_streamed_objects_are_the_read_ones(spark, tmp_path):
    """Arrays, a wrong type, a broken file and an empty one, over three runs of one query."""
    files = {
        "1.json": f"[{speed('a', 1.5)},{speed('b', 'x')}]", "2.json": "{broken", "3.json": "[]",
        "4.json": json.dumps({"camera_id": "c", "speed": 3}, indent=1), "5.json": "",
    }
    read = []
    for k, (name, text) in enumerate(files.items()):
        put(tmp_path / "tree", name, text)
        if k % 2:
            continue
        live = json_feed.stream_json(spark, str(tmp_path / "tree"), schemas.RAW_SPEED, per_trigger=1)
        writer = live.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck"))
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
        read.append(len([p for p in query.recentProgress if p["numInputRows"]]))
    key = lambda r: str(sorted(r.items(), key=str))
    got = sorted(dicts(spark.read.schema(live.schema).parquet(str(tmp_path / "out"))), key=key)
    assert got == sorted(dicts(json_feed.read_json(spark, str(tmp_path / "tree"), schemas.RAW_SPEED)), key=key)
    assert {r["camera_id"] for r in got} >= {"a", "b", "c"}


FEED = "camera_id string, ts string, kind string, speed double, temp double"


def rows(batch):
    temp = F.to_json(F.struct(F.struct("temp").alias("main")))
    doc = F.when(F.col("kind") == "weather", F.from_json(temp, schemas.WEATHER_DOC))
    return batch.select("camera_id", F.col("ts").cast("timestamp").alias("ts"), "kind", "speed", doc.alias("doc"))


def test_what_the_watermark_dropped_is_found_and_mended(spark, tmp_path):
    schema = schemas.T.StructType.fromDDL(FEED)
    (tmp_path / "in").mkdir()
    batches = [
        [("a", "2024-01-01 00:01:00", "speed", 10.0, None), ("a", "2024-01-01 00:02:00", "weather", None, 30.0),
         ("b", "2024-01-01 00:03:00", "frame", None, None), ("a", "2024-01-01 00:30:00", "frame", None, None)],
        [("a", "2024-01-01 00:50:00", "speed", 20.0, None)],
        # Too late: a sample, a newer weather document, and a slot that was never seen.
        [("a", "2024-01-01 00:01:30", "speed", 50.0, None), ("b", "2024-01-01 00:04:00", "weather", None, 25.0),
         ("c", "2024-01-01 00:00:00", "frame", None, None), ("a", "2024-01-01 01:30:00", "frame", None, None)],
        # Not late: its slot is open.
        [("a", "2024-01-01 01:29:00", "speed", 70.0, None)],
    ]
    for k, batch in enumerate(batches):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(FEED.replace(" string", "").replace(" double", "").split(", "), r))) for r in batch))
        live = rows(stream.file_records(spark, str(tmp_path / "in"), schema, per_trigger=1))
        stream.append_days(stream.stream_slot_rows(live, local=False), f"{tmp_path}/out", f"{tmp_path}/ck", once=True).awaitTermination()
    streamed = spark.read.parquet(f"{tmp_path}/out").drop("dt")
    whole = stream.stream_slot_rows(rows(spark.read.schema(schema).json(str(tmp_path / "in"))), local=False)
    found = late.late_slots(whole, streamed)
    got = {(r["camera_id"], r["late_frames"], r["late_samples"], r["missed"], r["completeness"]) for r in dicts(found)}
    assert got == {("a", 0, 1, False, 66), ("b", 0, 0, False, 66), ("c", 1, 0, True, 33)}
    mended = {(r["camera_id"], str(r["slot"])): r for r in dicts(late.mended(streamed, found))}
    closed = {k: r for r in dicts(whole) if (k := (r["camera_id"], str(r["slot"]))) in mended}
    assert mended == closed and len(mended) == 5
    assert late.late_slots(whole, late.mended(streamed, found)).count() == 0
    assert late.late_slots(whole, streamed.limit(0)).count() == 0
