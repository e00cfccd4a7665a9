from datetime import date, datetime

import pytest
from helpers import at, dicts, one
from pyspark.sql import functions as F

from slotwise.functions import cleaning as clean
from slotwise.functions import labels
from slotwise.functions import timekeys as tk
from slotwise.functions.numeric import array_at, percent, ratio, rounded, safe_divide

NTZ = "timestamp_ntz"


@pytest.mark.parametrize("moment, slot", [
    ("2024-01-01 00:04:59.999", "2024-01-01 00:00:00"),
    ("2024-01-01 00:05:00", "2024-01-01 00:05:00"),
    ("2024-01-01 23:59:59.999999", "2024-01-01 23:55:00"),
])
def test_slot_floor_on_both_timestamp_types(spark, moment, slot):
    for kind in (NTZ, "timestamp"):
        got = spark.range(1).select(tk.slot_floor(F.lit(moment).cast(kind)).alias("s"))
        assert got.dtypes == [("s", kind)]
        assert got.select(F.col("s").cast("string")).first()[0] == slot


def test_slot_previous_is_the_last_complete_slot(spark):
    assert one(spark, tk.slot_previous(F.lit("2024-01-01 00:07:10").cast(NTZ))) == at("2024-01-01 00:00:00")
    assert one(spark, tk.slot_previous(F.lit("2024-01-01 00:05:00").cast(NTZ))) == at("2024-01-01 00:00:00")


def test_first_slot_at_or_after():
    assert tk.first_slot_at_or_after(datetime(2024, 1, 1, 0, 5)) == datetime(2024, 1, 1, 0, 5)
    assert tk.first_slot_at_or_after(datetime(2024, 1, 1, 0, 5, 1)) == datetime(2024, 1, 1, 0, 10)
    assert tk.first_slot_at_or_after(datetime(2024, 1, 1, 23, 59, 59)) == datetime(2024, 1, 2)


def test_date_header_to_local_slot(spark):
    fallback = F.lit("2020-01-01 00:00:00").cast(NTZ)
    utc = tk.parse_http_date(F.lit("Tue, 18 Nov 2025 17:03:21 GMT"), fallback)
    local = tk.to_local(utc)
    assert one(spark, utc) == at("2025-11-18 17:03:21")
    assert one(spark, F.date_format(tk.slot_floor(local), "yyyy-MM-dd'T'HH:mm:ss")) == "2025-11-19T00:00:00"
    for bad in ("nonsense", "", None):
        assert one(spark, tk.parse_http_date(F.lit(bad).cast("string"), fallback)) == at("2020-01-01 00:00:00")


def test_header_does_not_depend_on_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        utc = tk.parse_http_date(F.lit("Tue, 18 Nov 2025 17:03:21 GMT"), F.lit(None).cast(NTZ))
        assert one(spark, utc.cast("string")) == "2025-11-18 17:03:21"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_slot_texts(spark):
    now = F.lit("2030-01-01 00:00:00").cast(NTZ)
    for text in ("2025-12-10T08:45:00", "2025-12-10 08:45:00"):
        assert one(spark, tk.slot_text(F.lit(text))) == "2025-12-10 08:45:00"
        assert one(spark, tk.generated_at(F.lit(text), now)) == "2025-12-10 08:50:00"
    assert one(spark, tk.slot_text(F.lit("10/12T08"))) == "10/12 08"
    assert one(spark, tk.generated_at(F.lit("10/12T08"), now)) == "2030-01-01 00:00:00"


def test_object_keys_and_their_inverse(spark):
    keys = tk.object_keys(F.lit("cam"), F.lit("2025-11-19 00:03:21").cast(NTZ), "bucket")
    row = spark.range(1).select(*[v.alias(k) for k, v in keys.items()]).first().asDict()
    assert row["speed_key"] == "raw/dt=2025-11-19/speed/cam/2025-11-19T00-00-00/cam_2025-11-19T00-03-21.json"
    assert row["image_ref"] == "s3://bucket/raw/dt=2025-11-19/images/cam_2025-11-19T00:03:21.jpg"
    assert one(spark, tk.slot_from_path(F.lit("file:/x/" + row["speed_key"]))) == at("2025-11-19 00:00:00")
    assert one(spark, tk.camera_from_path(F.lit("file:/x/" + row["manifest_key"]))) == "cam"


def test_weekdays(spark):
    # Saturday, Sunday, Monday
    days = spark.createDataFrame([(at(f"2024-01-{d:02d}"),) for d in (6, 7, 8)], "t timestamp_ntz")
    got = days.select(tk.day_name(F.col("t")), tk.day_short(F.col("t")), tk.day_type(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [
        ("Saturday", "T7", "Weekend"), ("Sunday", "CN", "Weekend"), ("Monday", "T2", "Workday")]


def test_rush_hours_differ_by_report(spark):
    eight_pm = F.lit("2024-01-01 20:10:00").cast(NTZ)
    assert one(spark, tk.time_period(eight_pm)) == "Rush Hour"
    assert one(spark, tk.time_period(eight_pm, tk.RUSH_HOURS_SPEED_PAGE)) == "Off-Peak"
    assert one(spark, tk.hour_block(eight_pm, 4)) == 5


def test_whole_day_end_adds_a_day():
    assert tk.whole_day_end(date(2024, 1, 20)) == datetime(2024, 1, 21, 23, 59, 59)


@pytest.mark.parametrize("bands, value, label", [
    (labels.SPEED_BIN, 10.0, "10-20"), (labels.SPEED_BIN, 50.0, "50+"), (labels.SPEED_BIN, None, "50+"),
    (labels.SPEED_CATEGORY, 9.99, "Nguy cơ cao (<10)"), (labels.SPEED_CATEGORY, 20.0, "Đông xe (20-30)"),
    (labels.SPEED_CATEGORY, 30.0, "Bình thường (30-50)"),
    (labels.RISK_LEVEL, 10.0, "Nguy cơ vừa (10-15)"), (labels.RISK_LEVEL, 15.0, "Cảnh báo (15-25)"),
    (labels.RISK_LEVEL, 25.0, "Thông thoáng (>25)"),
    (labels.SPEED_STATUS, 15.0, "Đông xe"), (labels.SPEED_STATUS, 25.0, "Bình thường"), (labels.SPEED_STATUS, 35.0, "Thông thoáng"),
])
def test_bands_include_their_lower_bound(spark, bands, value, label):
    column = F.lit(value).cast("double")
    assert one(spark, bands.label(column)) == label
    assert bands.labels[one(spark, bands.rank(column)) - 1] == label


def test_lights(spark):
    assert one(spark, labels.traffic_light(F.lit(5.0), 10, 20)) == "green"
    assert one(spark, labels.traffic_light(F.lit(10.0), 10, 20)) == "yellow"
    assert one(spark, labels.traffic_light(F.lit(20.0), 10, 20)) == "red"
    assert one(spark, labels.traffic_light(F.lit(5.0), 10, 20, high_is_bad=False)) == "red"
    assert one(spark, labels.gauge_band(F.lit(40.0), 100)) == "yellow"
    assert one(spark, labels.bullet_band(F.lit(30.0), 10, 20, 30)) == "excellent"


@pytest.mark.parametrize("z, speed, wanted", [
    (4.0, 10.0, "Sudden Spike"), (-3.5, 10.0, "Sudden Drop"), (3.0, 10.0, "Congestion"),
    (-3.0, 20.0, "Normal"), (None, 14.9, "Congestion"), (None, None, "Normal"),
])
def test_alert_type_first_match_wins(spark, z, speed, wanted):
    congested = labels.is_congested(F.lit(speed).cast("double"))
    assert one(spark, labels.alert_type(F.lit(z).cast("double"), congested)) == wanted


def test_numbers(spark):
    assert one(spark, safe_divide(F.lit(6.0), F.lit(0.0), 7.0)) == 7.0
    assert one(spark, safe_divide(F.lit(6.0), F.lit(None).cast("double"))) == 0.0
    assert one(spark, safe_divide(F.lit(6.0), F.lit(4.0))) == 1.5
    assert one(spark, ratio(F.lit(1), F.lit(0))) is None
    assert one(spark, percent(F.lit(1), F.lit(3))) == 33.3
    assert one(spark, rounded(F.lit(2.25))) == 2.3
    assert one(spark, array_at(F.array(F.lit(1.0)), 7)) is None
    assert one(spark, labels.marker_size(F.lit(1.0))) == 9.0


def test_speed_records(spark):
    rows = [
        ("31", "t1", None), ("30.5", "t1", None), ("x", "t1", None), (None, "t1", None), ("12", None, None),
        ("13", None, "t2"), ("14", "", "t3"), ("15", "", ""), ("nan", "t1", None), ("Infinity", "t1", None),
        ("31d", "t1", None), (" 1e1 ", "2024-01-01T00:00:00", None),
    ]
    df = spark.createDataFrame(rows, "speed string, time string, timestamp string")
    kept = df.select(
        clean.speed_value(F.col("speed")).alias("v"), clean.speed_time(F.col("time"), F.col("timestamp")).alias("t")
    ).where("v is not null and t is not null")
    assert [tuple(r) for r in kept.collect()] == [
        (31.0, "t1"), (30.5, "t1"), (13.0, "t2"), (14.0, "t3"), (10.0, "2024-01-01 00:00:00")]


def test_frame_refs(spark):
    df = spark.createDataFrame([("s3://b/x", None), (None, "y"), ("", "z"), ("a", "k"), (None, "")], "r string, k string")
    got = [row["f"] for row in dicts(df.select(clean.frame_ref(F.col("r"), F.col("k"), "b").alias("f")))]
    assert got == ["s3://b/x", "s3://b/y", "s3://b/z", "s3://b/a", None]
