"""Slot keys, calendar labels and object keys."""

from __future__ import annotations

from datetime import date, datetime, time, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

SLOT_MINUTES = 5
SLOT_SECONDS = 300
LOCAL_ZONE = "Asia/Ho_Chi_Minh"

# Fixed value: the format of an HTTP date after its weekday.
HTTP_DATE = "dd MMM yyyy HH:mm:ss z"

# The two rush-hour sets in use (SQL reports / speed page).
RUSH_HOURS = (7, 8, 9, 17, 18, 19, 20)
RUSH_HOURS_SPEED_PAGE = (7, 8, 9, 17, 18, 19)

# Spark numbers weekdays 1 = Sunday .. 7 = Saturday.
DAY_NAMES = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")
DAY_SHORT = ("CN", "T2", "T3", "T4", "T5", "T6", "T7")


def slot_floor(ts: Column) -> Column:
    """Start of the 5-minute slot holding ``ts``; keeps the input's timestamp type."""
    into_slot = F.make_dt_interval(
        F.lit(0), F.lit(0), F.minute(ts) % SLOT_MINUTES, F.extract(F.lit("SECOND"), ts)
    )
    return ts - into_slot


def slot_previous(now: Column) -> Column:
    """The newest slot that was already complete at ``now``."""
    return slot_floor(now - F.expr(f"INTERVAL {SLOT_MINUTES} MINUTES"))


def first_slot_at_or_after(moment: datetime) -> datetime:
    """The slot boundary at or after a moment: turns slot bounds into raw-time bounds."""
    midnight = datetime.combine(moment.date(), time.min)
    slots = -((midnight - moment) // timedelta(seconds=SLOT_SECONDS))
    return midnight + slots * timedelta(seconds=SLOT_SECONDS)


def as_utc(instant: Column) -> Column:
    """An instant as UTC wall-clock time, whatever the session's zone is."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), instant.cast("timestamp_ntz"))


def to_local(utc: Column) -> Column:
    """UTC wall-clock time as the deployment's local wall-clock time."""
    return F.convert_timezone(F.lit("UTC"), F.lit(LOCAL_ZONE), utc)


def parse_http_date(header: Column, fallback: Column) -> Column:
    """UTC time of an HTTP ``Date`` header such as ``Tue, 18 Nov 2025 17:03:21 GMT``.

    The weekday is skipped (Spark cannot parse it); anything unreadable gives ``fallback``.
    """
    instant = F.try_to_timestamp(F.substring(F.trim(header), 6, 64), F.lit(HTTP_DATE))
    return F.coalesce(as_utc(instant), fallback)


def parse_slot(text: Column) -> Column:
    """A slot key with a ``T`` or a space between date and time; NULL when neither fits."""
    parse = lambda pattern: F.try_to_timestamp(text, F.lit(pattern)).cast("timestamp_ntz")
    return F.coalesce(parse("yyyy-MM-dd'T'HH:mm:ss"), parse("yyyy-MM-dd HH:mm:ss"))


def slot_text(text: Column) -> Column:
    """Canonical text of a slot key; an unreadable key only has its ``T`` replaced."""
    return F.coalesce(
        F.date_format(parse_slot(text), "yyyy-MM-dd HH:mm:ss"), F.replace(text, F.lit("T"), F.lit(" "))
    )


def generated_at(text: Column, now_local: Column) -> Column:
    """End of the slot, or the given local time when the key cannot be read."""
    end = parse_slot(text) + F.expr(f"INTERVAL {SLOT_MINUTES} MINUTES")
    return F.date_format(F.coalesce(end, now_local), "yyyy-MM-dd HH:mm:ss")


def object_keys(camera_id: Column, local: Column, bucket: str) -> dict[str, Column]:
    """Object keys of one frame taken at local time ``local``.

    Keys that Spark lists use ``HH-mm-ss``, as its file reader rejects colons in paths;
    images are only referred to, so their keys have the time as the source writes it.
    """
    slot = slot_floor(local)
    dt = F.date_format(slot, "yyyy-MM-dd")
    slot_part = F.date_format(slot, "yyyy-MM-dd'T'HH-mm-ss")
    frame_part = F.date_format(local, "yyyy-MM-dd'T'HH-mm-ss")
    fill = lambda pattern, *parts: F.format_string(pattern, *parts)
    # The folder layout.
    keys = {
        "latest_key": fill("latest/%s.jpg", camera_id),
        "image_key": fill("raw/dt=%s/images/%s_%s.jpg", dt, camera_id, F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss")),
        "weather_key": fill("raw/dt=%s/weather/%s_%s.json", dt, camera_id, slot_part),
        "speed_key": fill("raw/dt=%s/speed/%s/%s/%s_%s.json", dt, camera_id, slot_part, camera_id, frame_part),
        "manifest_key": fill("manifest/dt=%s/%s/%s/%s_%s.json", dt, camera_id, slot_part, camera_id, frame_part),
        "batch_key": fill("batch/dt=%s/%s_%s.json", dt, camera_id, slot_part),
    }
    keys["image_ref"] = F.concat(F.lit(f"s3://{bucket}/"), keys["image_key"])
    return keys


def slot_from_path(path: Column) -> Column:
    """Inverse of :func:`object_keys`: the slot folder named in a speed or manifest path."""
    name = F.regexp_extract(path, r"/(\d{4}-\d{2}-\d{2}T\d{2}-\d{2}-\d{2})/[^/]+$", 1)
    return F.try_to_timestamp(name, F.lit("yyyy-MM-dd'T'HH-mm-ss")).cast("timestamp_ntz")


def camera_from_path(path: Column) -> Column:
    """Inverse of :func:`object_keys`: the camera folder named in a speed or manifest path."""
    return F.regexp_extract(path, r"/([^/]+)/\d{4}-\d{2}-\d{2}T\d{2}-\d{2}-\d{2}/[^/]+$", 1)


def day_name(ts: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, DAY_NAMES)), F.dayofweek(ts))


def day_short(ts: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, DAY_SHORT)), F.dayofweek(ts))


def day_type(ts: Column) -> Column:
    return F.when(F.dayofweek(ts).isin(1, 7), "Weekend").otherwise("Workday")


def time_period(ts: Column, hours: tuple[int, ...] = RUSH_HOURS) -> Column:
    return F.when(F.hour(ts).isin(*hours), "Rush Hour").otherwise("Off-Peak")


def hour_block(ts: Column, width: int) -> Column:
    return F.floor(F.hour(ts) / width)


def whole_day_end(day: date) -> datetime:
    """End of the window for a chosen last day: that day's last second, plus one day."""
    return datetime.combine(day, time.max).replace(microsecond=0) + timedelta(days=1)
