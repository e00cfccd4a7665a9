"""Small hand-made tables."""

from datetime import datetime

from pyspark.sql import functions as F

from slotwise import schemas
from slotwise.sources.tables import FrameTables


def at(text: str) -> datetime:
    return datetime.fromisoformat(text)


def weather(main=None, temp=None, humidity=None):
    values = dict.fromkeys(schemas.WEATHER.fieldNames())
    values.update(main=main, temp=temp, humidity=humidity)
    return values


def events(spark, rows):
    """Rows of (camera, slot text, vehicles, speed[, weather main])."""
    full = [
        (r[0], at(r[1]), None, 300, r[2], None if r[3] is None else 1, r[3], r[3], r[3], None,
         weather(r[4] if len(r) > 4 else None))
        for r in rows
    ]
    return spark.createDataFrame(full, schemas.EVENTS)


def cameras(spark, rows):
    """Rows of (camera, district)."""
    full = [(c, f"name {c}", d, 106.5, 10.5, "UP", "NO", "FIXED") for c, d in rows]
    return spark.createDataFrame(full, schemas.CAMERAS)


def predicts(spark, rows):
    return spark.createDataFrame([(c, at(s), counts, speeds) for c, s, counts, speeds in rows], schemas.PREDICTS)


def tables(spark, event_rows, camera_rows=(("a", "d1"),), predict_rows=()):
    return FrameTables(events(spark, event_rows), cameras(spark, camera_rows), predicts(spark, predict_rows))


def one(spark, expression, **values):
    """The value of one column expression over named literals."""
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(expression.alias("out")).first()["out"]


def dicts(df):
    return [row.asDict(recursive=True) for row in df.collect()]
