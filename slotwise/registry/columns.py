"""Column functions, filters and joins by name."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from slotwise.functions import cleaning as clean
from slotwise.functions import labels
from slotwise.functions import timekeys as tk
from slotwise.functions.numeric import array_at, ratio, rounded, safe_divide
from slotwise.operators import filters, ranking, slots
from slotwise.operators.calendar import fill_calendar
from slotwise.operators.joins import join_cameras, join_predicts, left_join_slots, unnest_series
from slotwise.operators.rollup import per_camera
from slotwise.plans import anomaly, city
from slotwise.plans.windows import day_start, trailing
from slotwise.registry.base import AS_OF, BUCKET, DAYS, register

KEY = ["camera_id", "slot"]


# Keys and parsing


def _http_header():
    dated = F.concat(F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    return F.when(F.col("event_type") == "error", "not a date").when(F.col("event_type") != "view", dated)


def _slot_key():
    """Slot texts as the feeds write them: with a T, with a space, or unreadable."""
    style = F.col("event_type")
    return (
        F.when(style.isin("click", "purchase"), F.date_format("slot", "yyyy-MM-dd'T'HH:mm:ss"))
        .when(style == "error", F.date_format("slot", "yyyy-MM-dd'T'HH:mm"))
        .otherwise(F.date_format("slot", "yyyy-MM-dd HH:mm:ss"))
    )


register("slot_floor", lambda src: src.raw().select("event_id", tk.slot_floor(F.col("ts")).alias("slot")))
register("slot_previous", lambda src: src.raw().select("event_id", tk.slot_previous(F.col("ts")).alias("slot")))
register("parse_http_date", lambda src: src.raw().select(
    "event_id", tk.parse_http_date(_http_header(), F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("event_time")))


def _local(src):
    local = tk.to_local(F.col("ts"))
    return src.raw().select(
        "event_id",
        F.date_format(tk.slot_floor(local), "yyyy-MM-dd").alias("local_date"),
        F.date_format(tk.slot_floor(local), "yyyy-MM-dd'T'HH:mm:ss").alias("local_slot"),
        F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss").alias("frame_time"),
    )


register("to_local_time", _local)


def _paths(src):
    keys = tk.object_keys(F.col("camera_id"), tk.to_local(F.col("ts")), BUCKET)
    paths = src.raw().select("event_id", *[value.alias(name) for name, value in keys.items()])
    return paths.withColumns({
        "path_slot": tk.slot_from_path(F.col("speed_key")),
        "path_camera": tk.camera_from_path(F.col("speed_key")),
    })


register("derive_paths", _paths)


def _require_camera(src):
    kind = F.col("event_type")
    given = F.when(kind == "error", F.lit("  ")).when(kind != "signup", F.col("camera_id"))
    records = src.raw().select("event_id", given.alias("camera_id"))
    kept = records.where(clean.has_camera(F.col("camera_id"))).withColumn("route", F.lit("accepted"))
    return kept.unionByName(slots.rejected(records).withColumn("route", F.lit("rejected")))


register("require_camera", _require_camera)
register("parse_slot", lambda src: src.raw().withColumn("key", _slot_key()).select(
    "event_id", "key", tk.slot_text(F.col("key")).alias("slot_out"),
    tk.generated_at(F.col("key"), F.lit(AS_OF).cast("timestamp_ntz")).alias("generated_at")))
register("clean_frames", lambda src: slots.clean_frames(src.raw_frames(), BUCKET))
register("clean_speed", lambda src: slots.clean_speed(src.raw_speed()))


# Scalars over slots

register("weather_fields", lambda src: src.events().select(
    *KEY, *[F.col(f"weather.{f}").alias(f) for f in ("main", "temp", "humidity", "wind_speed", "clouds_all")]))
register("array_at", lambda src: src.predicts().select(
    *KEY,
    array_at(F.col("count_preds"), 1).alias("count_t1"),
    *[array_at(F.col("avg_kmh_preds"), step).alias(f"speed_t{step}") for step in (1, 7, 12, 13)]))
register("day_name", lambda src: src.events().select(
    *KEY, tk.day_name(F.col("slot")).alias("day_name"), tk.day_short(F.col("slot")).alias("day_short")))
register("day_type", lambda src: src.events().select(*KEY, tk.day_type(F.col("slot")).alias("day_type")))
register("time_period", lambda src: src.events().select(
    *KEY,
    tk.time_period(F.col("slot")).alias("period"),
    tk.time_period(F.col("slot"), tk.RUSH_HOURS_SPEED_PAGE).alias("page_period")))
register("hour_block", lambda src: src.events().select(
    *KEY, tk.hour_block(F.col("slot"), 2).alias("block2"), tk.hour_block(F.col("slot"), 4).alias("block4")))


def _band(name: str, bands: labels.Bands):
    def build(src):
        speed = F.col("speed_avg_kmh")
        return src.events().select(*KEY, bands.label(speed).alias("label"), bands.rank(speed).alias("rank"))

    register(name, build)


_band("speed_bin", labels.SPEED_BIN)
_band("speed_category", labels.SPEED_CATEGORY)
_band("speed_status", labels.SPEED_STATUS)
register("risk_level", lambda src: src.predicts().select(
    *KEY,
    labels.RISK_LEVEL.label(array_at(F.col("avg_kmh_preds"), 1)).alias("label"),
    labels.RISK_LEVEL.rank(array_at(F.col("avg_kmh_preds"), 1)).alias("rank")))
register("traffic_light_band", lambda src: src.events().select(
    *KEY,
    labels.traffic_light(F.col("vehicles_count"), 20, 60).alias("volume_light"),
    labels.traffic_light(F.col("speed_avg_kmh"), 15, 25, high_is_bad=False).alias("speed_light"),
    labels.gauge_band(F.col("speed_avg_kmh"), 50).alias("gauge"),
    labels.bullet_band(F.col("speed_avg_kmh"), 10, 20, 40).alias("bullet")))
# Every slot, against all slots of its camera.
register("alert_type", lambda src: anomaly.scored(src.events(), anomaly.baseline(src.events())).select(
    *KEY, labels.alert_type(F.col("z_score"), labels.is_congested(F.col("speed_avg_kmh"))).alias("alert_type")))
register("safe_divide", lambda src: src.events().select(
    *KEY, safe_divide(F.col("vehicles_count"), F.col("speed_min_kmh"), -1.0).alias("per_kmh")), 6)
register("marker_size", lambda src: src.events().select(*KEY, labels.marker_size(F.col("vehicles_count")).alias("size")), 6)


# Filters

EARLY, LATE = datetime(2024, 1, 5, 0, 2, 0), datetime(2024, 1, 25, 12, 3, 0)
PLAIN = [*KEY, "vehicles_count", "speed_avg_kmh"]

register("time_range", lambda src: src.events(EARLY, LATE).select(*PLAIN))
register("end_date_window", lambda src: src.events(*trailing(tk.whole_day_end(date(2024, 1, 20)), 14)).select(*PLAIN))
register("in_list", lambda src: filters.in_list(
    city.traffic_events(src, AS_OF, DAYS), "district", ["NATION_1", "NATION_5", "NATION_12"]).select(*PLAIN, "district"))
register("day_type_filter", lambda src: filters.on_day_type(src.events(), "Weekend").select(*PLAIN))
register("not_null", lambda src: join_cameras(src.events(), src.cameras()).where(
    F.col("speed_avg_kmh").isNotNull() & F.col("district").isNotNull()).select(*PLAIN, "district"))
register("nested_predicate", lambda src: src.events().where(
    (F.col("weather.temp") > 30) & (F.col("weather.humidity") > 80)).select(
    *PLAIN, F.col("weather.temp").alias("temp"), F.col("weather.humidity").alias("humidity")))
register("having", lambda src: per_camera(src.events()).where(F.col("slow_slots") >= 20).select("camera_id", "slots", "slow_slots"))


# Joins

register("join_camera", lambda src: join_cameras(src.events(), src.cameras()).select(*PLAIN, "display_name", "district", "status"))
register("join_predict", lambda src: join_predicts(src.events(), src.predicts()).select(
    *PLAIN, array_at(F.col("count_preds"), 1).alias("count_t1")))
register("join_baseline", lambda src: anomaly.with_baseline(src, AS_OF).select(
    *KEY, "vehicles_count", "avg_vehicles", "std_vehicles", "z_score"), 6)


def _left_join(src):
    today = per_camera(src.events(day_start(AS_OF)), extra=(F.max("slot").alias("last_slot"),))
    return left_join_slots(src.cameras(), today).select(
        "camera_id", "display_name", F.coalesce("slots", F.lit(0)).alias("slots"), "last_slot",
        rounded(ratio(F.col("speed_sum"), F.col("speed_n"))).alias("avg_speed"))


register("left_join_today", _left_join)
register("unnest", lambda src: unnest_series(src.events(series=True)).groupBy("camera_id").agg(
    F.count(F.lit(1)).alias("samples"), F.sum("speed").alias("speed_sum"), F.max("time").alias("last_time")))
register("calendar_fill", lambda src: fill_calendar(
    src.table("orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("orders"))))
register("latest_n_slots", lambda src: ranking.latest_slots(src.events(), 12).select(*PLAIN))
