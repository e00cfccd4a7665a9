import json
import time
from datetime import timedelta

from helpers import at, dicts
from pyspark.sql import functions as F

from slotwise import schemas
from slotwise.operators import slots
from slotwise.operators.series import with_series
from slotwise.plans import ingest
from slotwise.sources import json_feed, sinks
from slotwise.sources.tables import StoredTables

SLOT = at("2024-01-01 00:00:00")
DOC = {"weather": [{"id": 500, "main": "Rain"}], "main": {"temp": 30.5}, "wind": {"speed": 2.0}, "clouds": {"all": 75}}


def samples_of(spark, rows):
    return spark.createDataFrame(rows, "camera_id string, slot timestamp_ntz, time string, speed double")


def frames_of(spark, rows):
    return spark.createDataFrame(rows, "camera_id string, slot timestamp_ntz, time string, image_ref string")


def weather_of(spark, cameras):
    raw = spark.createDataFrame([(c, SLOT, at("2024-01-01 00:01:00"), json.dumps(DOC)) for c in cameras],
                                "camera_id string, slot timestamp_ntz, ts timestamp_ntz, j string")
    typed = raw.select("camera_id", "slot", "ts", F.from_json("j", schemas.WEATHER_DOC).alias("d")).select(
        "camera_id", "slot", "ts", "d.*")
    return slots.latest_weather(typed, "ts")


def feeds(spark):
    frames = frames_of(spark, [(c, SLOT, "t", "s3://b/i") for c in ("f", "fs", "all")])
    samples = samples_of(spark, [(c, SLOT, f"2024-01-01 00:0{m}:00", v)
                                 for c in ("s", "fs", "all") for m, v in ((2, 30.0), (1, 10.0))])
    return frames, samples, weather_of(spark, ["w", "all"])


def test_completeness_counts_the_parts(spark):
    got = {r["camera_id"]: r["completeness"] for r in dicts(slots.slot_parts(*feeds(spark)))}
    assert got == {"f": 33, "s": 33, "w": 33, "fs": 66, "all": 100}
    assert spark.range(1).select(slots.completeness(F.lit(False), F.lit(None).cast("boolean"), F.lit(False))).first()[0] == 0


def test_documents(spark):
    got = {r["camera_id"]: r for r in dicts(slots.slot_documents(*feeds(spark)))}
    whole = got["all"]
    assert whole["slot"] == "2024-01-01 00:00:00" and whole["generated_at"] == "2024-01-01 00:05:00"
    assert whole["speed"]["series"] == [
        {"time": "2024-01-01 00:01:00", "speed": 10.0}, {"time": "2024-01-01 00:02:00", "speed": 30.0}]
    assert (whole["speed"]["count"], whole["speed"]["avg_kmh"]) == (2, 20.0)
    assert got["f"]["speed"] is None and got["f"]["weather"] is None and len(got["f"]["frames"]) == 1
    assert got["w"]["frames"] == []


def test_flatten_fills_defaults(spark):
    rows = {r["camera_id"]: r for r in dicts(slots.flatten_documents(slots.slot_documents(*feeds(spark))))}
    assert rows["all"]["weather"]["main"] == "Rain" and rows["all"]["weather"]["pressure"] is None
    assert rows["all"]["weather"]["clouds_all"] == 75
    assert rows["f"]["vehicles_count"] == 0.0 and rows["f"]["speed_count"] is None and rows["f"]["weather"] is None
    flat = slots.flatten_documents(slots.slot_documents(*feeds(spark)))
    assert [f.name for f in flat.schema] == schemas.EVENTS.fieldNames()


def test_a_busy_slot_is_an_array_on_request(spark):
    rows = [("hot", SLOT, f"2024-01-01 00:00:{i:02d}", float(i)) for i in range(30)] + [("calm", SLOT, "2024-01-01 00:00:00", 5.0)]
    samples = samples_of(spark, rows)
    documents = slots.slot_documents(frames_of(spark, []), samples, weather_of(spark, []))
    hot = [r for r in dicts(documents) if r["camera_id"] == "hot"][0]
    assert hot["speed"]["count"] == 30 and [s["speed"] for s in hot["speed"]["series"]] == list(map(float, range(30)))
    bare = slots.slot_documents(frames_of(spark, []), samples, weather_of(spark, []), arrays=False)
    assert bare.schema == documents.schema or [f.name for f in bare.schema] == [f.name for f in documents.schema]
    assert all(r["speed"]["series"] is None for r in dicts(bare))


def test_weather_of_the_same_instant_is_the_same_each_time(spark):
    docs = [{**DOC, "main": {"temp": t}} for t in (1.0, 2.0)]
    for order in (docs, docs[::-1]):
        raw = spark.createDataFrame([("a", SLOT, SLOT, json.dumps(d)) for d in order], "camera_id string, slot timestamp_ntz, ts timestamp_ntz, j string")
        typed = raw.select("camera_id", "slot", "ts", F.from_json("j", schemas.WEATHER_DOC).alias("d")).select("camera_id", "slot", "ts", "d.*")
        assert slots.latest_weather(typed, "ts").first().weather["main"]["temp"] == 2.0


def test_rejects(spark):
    raw = spark.createDataFrame([("a",), ("  ",), (None,)], "camera_id string")
    assert slots.rejected(raw).count() == 2


def test_json_files(spark, tmp_path):
    folder = tmp_path / "speed" / "cam" / "2024-01-01T00-05-00"
    folder.mkdir(parents=True)
    files = {
        "a.json": '{"time": "2024-01-01T00:06:00", "speed": 31}',
        "b.JSON": '[{"time": "2024-01-01T00:07:00", "speed": "30.5"}, {"timestamp": "2024-01-01T00:08:00", "speed": 1}]',
        "c.json": "{}", "d.json": "[]", "e.json": '{"time": ', "f.json": '{"time": "t", "speed": null}', "g.txt": '{"time": "t", "speed": 9}',
        "h.json": '[{"time": "t", "speed": 8}, {"time": ',
    }
    for name, text in files.items():
        (folder / name).write_text(text)
    assert json_feed.list_json(spark, str(tmp_path)).count() == 7
    records = json_feed.keyed_by_path(json_feed.read_json(spark, str(tmp_path), schemas.RAW_SPEED))
    cleaned = dicts(slots.clean_speed(records).orderBy("time"))
    assert [(r["camera_id"], r["slot"], r["time"], r["speed"]) for r in cleaned] == [
        ("cam", at("2024-01-01 00:05:00"), "2024-01-01 00:06:00", 31.0),
        ("cam", at("2024-01-01 00:05:00"), "2024-01-01 00:07:00", 30.5),
        ("cam", at("2024-01-01 00:05:00"), "2024-01-01 00:08:00", 1.0),
    ]


def test_json_arrays_round_trip(spark, tmp_path):
    rows = spark.range(100).select(F.col("id").cast("string").alias("camera_id"), F.lit("1").alias("speed")).repartition(3)
    json_feed.write_json_arrays(rows, str(tmp_path / "x"))
    back = json_feed.read_json(spark, str(tmp_path / "x"), schemas.RAW_SPEED, "part-*")
    assert back.count() == 100 and back.select("camera_id").distinct().count() == 100


def test_rerun_replaces_only_its_days(spark, tmp_path):
    def day(d, v):
        return spark.createDataFrame([("a", at(f"2024-01-0{d} 00:00:00"), [v], [v])], schemas.PREDICTS)

    tables = StoredTables(spark, str(tmp_path))
    sinks.write_predicts(day(1, 1.0).unionByName(day(2, 1.0)), tables.root)
    sinks.write_predicts(day(2, 2.0), tables.root)
    got = {r["slot"].day: r["count_preds"] for r in dicts(tables.predicts())}
    assert got == {1: [1.0], 2: [2.0]}
    assert tables.predicts(at("2024-01-02 00:00:00"), at("2024-01-03 00:00:00")).count() == 1


def test_camera_folders(spark, tmp_path):
    rows = spark.createDataFrame([("a", SLOT, [1.0], [1.0]), ("b", SLOT, [1.0], [1.0])], schemas.PREDICTS)
    sinks.write_days(rows, str(tmp_path / "p"), camera_folders=True)
    assert sorted(p.name for p in (tmp_path / "p" / "dt=2024-01-01").iterdir()) == ["camera_id=a", "camera_id=b"]


def stored(tables):
    events = {(r["camera_id"], r["slot"]): r for r in dicts(tables.events(series=True))}
    frames = sorted((r["camera_id"], r["slot"], r["image_ref"]) for r in dicts(tables.frames()))
    return events, frames


def test_batch_job_stores_complete_slots_whole(spark, tmp_path):
    tables = StoredTables(spark, str(tmp_path / "t"))
    assert tables.samples().count() == tables.frames().count() == 0
    open_slot = at("2024-01-01 00:10:00")
    samples = samples_of(spark, [("hot", SLOT, f"2024-01-01 00:00:{i:02d}", float(i)) for i in range(12)]
                         + [("calm", SLOT, "2024-01-01 00:01:00", 7.0), ("calm", open_slot, "2024-01-01 00:11:00", 8.0)])
    frames, weather = frames_of(spark, [("calm", SLOT, "t", "s3://b/i")]), weather_of(spark, ["calm"])
    ingest.store_slots(frames, samples, weather, tables, at("2024-01-01 00:12:00"))
    events, stored_frames = stored(tables)
    assert events["hot", SLOT]["speed_count"] == 12 and len(events["hot", SLOT]["speed_series"]) == 12
    assert events["calm", SLOT]["speed_series"] == [{"time": at("2024-01-01 00:01:00"), "speed": 7.0}]
    assert stored_frames == [("calm", SLOT, "s3://b/i")] and ("calm", open_slot) not in events
    assert tables.samples().count() == 13 and tables.samples().agg(F.max("time")).first()[0] == at("2024-01-01 00:01:00")


def test_second_run_loses_and_doubles_nothing(spark, tmp_path):
    tables, late = StoredTables(spark, str(tmp_path / "t")), at("2024-01-09 00:00:00")
    other, next_day = at("2024-01-01 00:05:00"), at("2024-01-02 00:00:00")

    def feed(*rows):
        return samples_of(spark, [(c, slot, f"{slot:%Y-%m-%d %H:%M}:{k:02d}", float(k)) for c, slot, n in rows for k in range(n)])

    none, frames = frames_of(spark, []), frames_of(spark, [("a", SLOT, "t", "s3://b/i"), ("b", next_day, "t", "s3://b/j")])
    ingest.store_slots(frames, feed(("a", SLOT, 9), ("a", other, 4), ("b", next_day, 2)), weather_of(spark, ["a"]), tables, late)
    # The first day again, with fewer samples and no frames.
    ingest.store_slots(none, feed(("a", SLOT, 3), ("a", other, 4)), weather_of(spark, ["a"]), tables, late)
    events, kept_frames = stored(tables)
    assert {k: r["speed_count"] for k, r in events.items()} == {("a", SLOT): 3, ("a", other): 4, ("b", next_day): 2}
    assert all(len(r["speed_series"]) == r["speed_count"] for r in events.values()) and tables.samples().count() == 9
    assert kept_frames == [("b", next_day, "s3://b/j")]
    # One slot alone: the day's other slots stay.
    ingest.store_slots(frames_of(spark, [("a", other, "t", "s3://b/k")]), feed(("a", other, 1)), weather_of(spark, []), tables, late, whole_days=False)
    events, kept_frames = stored(tables)
    assert {k: r["speed_count"] for k, r in events.items()} == {("a", SLOT): 3, ("a", other): 1, ("b", next_day): 2}
    assert tables.samples().count() == 6 and len(kept_frames) == 2 and events["a", SLOT]["weather"]["main"] == "Rain"


def test_slot_documents_replace_only_their_days(spark, tmp_path):
    path = str(tmp_path / "json")
    for day in ("2024-01-01", "2024-01-02", "2024-01-02"):
        slot = at(f"{day} 00:00:00")
        sinks.write_slot_documents(slots.slot_documents(
            frames_of(spark, [("a", slot, "t", "s3://b/i")]), samples_of(spark, []), weather_of(spark, [])), path)
    assert sorted(r.dt for r in spark.read.json(path).select(F.col("dt").cast("string").alias("dt")).collect()) == ["2024-01-01", "2024-01-02"]


def test_a_bad_field_costs_only_itself(spark, tmp_path):
    files = {
        "a.json": json.dumps({**DOC, "camera_id": "a", "main": {"temp": "n/a", "humidity": 40}}),
        "b.json": json.dumps([{**DOC, "camera_id": "b", "main": {"temp": "bad"}}, {**DOC, "camera_id": "c", "wind": "none"}, {**DOC, "camera_id": "d"}]),
        "e.json": "not json", "f.json": '{"camera_id": "f", "main": ', "g.json": "{}",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    got = {r.camera_id: r for r in json_feed.read_json(spark, str(tmp_path), schemas.RAW_WEATHER).collect()}
    assert {"a", "b", "c", "d"} <= set(got)
    assert got["a"].main.temp is None and got["a"].main.humidity == 40 and got["a"].clouds["all"] == 75
    assert got["b"].main.temp is None and got["b"].wind.speed == 2.0 and got["d"].main.temp == 30.5
    assert got["c"].wind is None or got["c"].wind.speed is None
    lost = json_feed.unreadable_files(spark, str(tmp_path), schemas.RAW_WEATHER).collect()
    assert sorted(r.path.rsplit("/", 1)[1] for r in lost) == ["e.json", "f.json"]


def test_large_days_of_metrics_are_cut_by_rows(spark, monkeypatch, tmp_path):
    start = at("2024-01-01T00:00:00")
    rows = [(start + timedelta(seconds=60 * k), f"m{k % 2}", {"i": str(k)}, float(k)) for k in range(2000)]
    samples = spark.createDataFrame(rows, "ts timestamp_ntz, metric string, labels map<string,string>, value double").coalesce(1)
    keyed = with_series(samples)
    assert sinks._pieces(keyed, "ts", ("ts", "series")) is None
    monkeypatch.setattr(sinks, "TASK_ROWS", 500)
    number, piece = sinks._pieces(keyed, "ts", ("ts", "series"))
    sizes = keyed.withColumn("dt", F.to_date("ts")).groupBy("dt", piece.alias("piece")).count().collect()
    assert number == 20 and [len([r for r in sizes if r.dt.day == d]) for d in (1, 2)] == [3, 2]
    assert max(r["count"] for r in sizes) < 700
    sinks.write_metrics(samples, str(tmp_path))
    found = StoredTables(spark, str(tmp_path)).metrics()
    assert sorted(r.value for r in found.collect()) == [float(k) for k in range(2000)]


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f for f in files.split("\n") if f.endswith(".data") and "shuffle_" in f}


def test_large_metrics_are_shuffled_some_days_at_a_time(spark, monkeypatch, tmp_path):
    start = at("2024-01-01T00:00:00")
    # The first instant of a day, the last one before it, and rows without a time.
    times = [start + timedelta(days=d, microseconds=us) for d in range(7) for us in (0, 1, 86_399_999_999)] + [None, None]
    rows = [(t, "m", {"i": str(k)}, float(k)) for k, t in enumerate(times)]
    samples = spark.createDataFrame(rows, "ts timestamp_ntz, metric string, labels map<string,string>, value double").repartition(3)
    sinks.write_metrics(samples, str(tmp_path / "once"))
    monkeypatch.setattr(sinks, "WRITE_ROWS", 5)
    before, key = _shuffle_files(spark), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    set_before = spark.conf.get(key)
    for _ in range(2):  # a re-run replaces the days
        sinks.write_metrics(samples, str(tmp_path / "cut"))
    writes = {}
    for file in (tmp_path / "cut" / "metrics").glob("dt=*/*.parquet"):
        writes.setdefault(file.name.split("-", 2)[2].split(".")[0].rsplit("-", 1)[0], set()).add(file.parent.name)
    none, day = "dt=__HIVE_DEFAULT_PARTITION__", "dt=2024-01-0{}".format
    assert sorted(map(sorted, writes.values())) == [[day(1), none], [day(2), day(3)], [day(4), day(5)], [day(6), day(7)]]
    read = lambda name: sorted(map(str, StoredTables(spark, str(tmp_path / name)).metrics().collect()))
    assert read("cut") == read("once") and len(read("cut")) == len(rows)
    assert spark.conf.get(key) == set_before
    until = time.monotonic() + 20
    while (left := _shuffle_files(spark) - before) and time.monotonic() < until:
        time.sleep(0.2)
    assert not left


def test_spans_leave_no_gap(monkeypatch):
    day = lambda d: at(f"2024-01-{d:02}T00:00:00").date()
    assert sinks._spans({}) == sinks._spans({None: 3}) == [(None, None)]
    monkeypatch.setattr(sinks, "WRITE_ROWS", 10)
    assert sinks._spans({day(3): 2, day(1): 9, day(2): 1, day(9): 50, day(10): 1}) == [(None, day(3)), (day(3), day(10)), (day(10), None)]
    # No more writes than MOST_WRITES, however many rows there are.
    assert len(sinks._spans({day(d): 1000 for d in range(1, 31)})) == 15
