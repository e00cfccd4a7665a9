"""Cleaning of raw records and flattening of the weather document."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def present(text: Column) -> Column:
    """The text, or NULL when it is empty."""
    return F.nullif(text, F.lit(""))


def has_camera(camera_id: Column) -> Column:
    """True for a usable camera id; NULL and blank are both unusable."""
    return F.coalesce(F.trim(camera_id) != "", F.lit(False))


def record_time(time: Column, timestamp: Column) -> Column:
    return F.coalesce(present(time), present(timestamp))


def speed_time(time: Column, timestamp: Column) -> Column:
    """The sample's time with a space between date and time."""
    return F.replace(record_time(time, timestamp), F.lit("T"), F.lit(" "))


def speed_value(text: Column) -> Column:
    """A finite number, or NULL.

    NaN and infinities are dropped on purpose; so is a Java suffix such as ``31d``,
    which a plain cast would take.
    """
    number = F.when(text.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), text.try_cast("double"))
    return F.when(F.abs(number) != float("inf"), number)


def frame_ref(image_ref: Column, image_key: Column, bucket: str) -> Column:
    """The image's full address; a bare key is put under the bucket."""
    ref = F.coalesce(present(image_ref), present(image_key))
    return F.when(ref.startswith("s3://"), ref).otherwise(F.concat(F.lit(f"s3://{bucket}/"), ref))


def flat_weather(doc: Column) -> Column:
    """The 15-field weather struct of the events table, from the nested API document."""
    first = F.get(doc["weather"], F.lit(0))
    fields = [first[name].alias(name) for name in ("id", "main", "description", "icon")]
    fields += [
        doc["main"][name].alias(name)
        for name in ("temp", "feels_like", "temp_min", "temp_max", "pressure", "humidity", "sea_level", "grnd_level")
    ]
    fields += [
        doc["wind"]["speed"].alias("wind_speed"),
        doc["wind"]["deg"].alias("wind_deg"),
        doc["clouds"]["all"].alias("clouds_all"),
    ]
    return F.when(doc.isNotNull(), F.struct(*fields))
