"""Schemas of the stored tables and of the raw JSON records."""

from pyspark.sql import types as T

SERIES = T.ArrayType(
    T.StructType([
        T.StructField("time", T.TimestampNTZType()),
        T.StructField("speed", T.DoubleType()),
    ])
)

WEATHER = T.StructType([
    T.StructField("id", T.IntegerType()),
    T.StructField("main", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("icon", T.StringType()),
    T.StructField("temp", T.DoubleType()),
    T.StructField("feels_like", T.DoubleType()),
    T.StructField("temp_min", T.DoubleType()),
    T.StructField("temp_max", T.DoubleType()),
    T.StructField("pressure", T.IntegerType()),
    T.StructField("humidity", T.IntegerType()),
    T.StructField("sea_level", T.IntegerType()),
    T.StructField("grnd_level", T.IntegerType()),
    T.StructField("wind_speed", T.DoubleType()),
    T.StructField("wind_deg", T.IntegerType()),
    T.StructField("clouds_all", T.IntegerType()),
])

EVENTS = T.StructType([
    T.StructField("camera_id", T.StringType(), False),
    T.StructField("slot", T.TimestampNTZType(), False),
    T.StructField("generated_at", T.TimestampNTZType()),
    T.StructField("duration_sec", T.IntegerType()),
    T.StructField("vehicles_count", T.DoubleType()),
    T.StructField("speed_count", T.IntegerType()),
    T.StructField("speed_avg_kmh", T.DoubleType()),
    T.StructField("speed_min_kmh", T.DoubleType()),
    T.StructField("speed_max_kmh", T.DoubleType()),
    T.StructField("speed_series", SERIES),
    T.StructField("weather", WEATHER),
])

CAMERAS = T.StructType([
    T.StructField("camera_id", T.StringType(), False),
    T.StructField("display_name", T.StringType()),
    T.StructField("district", T.StringType()),
    T.StructField("location_lon", T.DoubleType()),
    T.StructField("location_lat", T.DoubleType()),
    T.StructField("status", T.StringType()),
    T.StructField("ptz", T.StringType()),
    T.StructField("cam_type", T.StringType()),
])

PREDICTS = T.StructType([
    T.StructField("camera_id", T.StringType(), False),
    T.StructField("slot", T.TimestampNTZType(), False),
    T.StructField("count_preds", T.ArrayType(T.DoubleType()), False),
    T.StructField("avg_kmh_preds", T.ArrayType(T.DoubleType()), False),
])

SPEED_SAMPLES = T.StructType([
    T.StructField("camera_id", T.StringType(), False),
    T.StructField("slot", T.TimestampNTZType(), False),
    T.StructField("time", T.TimestampNTZType()),
    T.StructField("speed", T.DoubleType()),
])

FRAMES = T.StructType([
    T.StructField("camera_id", T.StringType(), False),
    T.StructField("slot", T.TimestampNTZType(), False),
    T.StructField("time", T.StringType()),
    T.StructField("image_ref", T.StringType()),
])

METRICS = T.StructType([
    T.StructField("ts", T.TimestampNTZType(), False),
    T.StructField("metric", T.StringType(), False),
    T.StructField("labels", T.MapType(T.StringType(), T.StringType())),
    T.StructField("series", T.StringType()),
    T.StructField("value", T.DoubleType()),
])

# Raw speed is read as text so that numbers and numeric strings both survive.
RAW_SPEED = T.StructType([
    T.StructField("camera_id", T.StringType()),
    T.StructField("slot", T.StringType()),
    T.StructField("time", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("speed", T.StringType()),
])

RAW_FRAME = T.StructType([
    T.StructField("camera_id", T.StringType()),
    T.StructField("slot", T.StringType()),
    T.StructField("time", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("image_ref", T.StringType()),
    T.StructField("image_key", T.StringType()),
])

# The public weather API document: a one-element condition list plus groups.
WEATHER_DOC = T.StructType([
    T.StructField("weather", T.ArrayType(T.StructType([
        T.StructField("id", T.IntegerType()),
        T.StructField("main", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("icon", T.StringType()),
    ]))),
    T.StructField("main", T.StructType([
        T.StructField("temp", T.DoubleType()),
        T.StructField("feels_like", T.DoubleType()),
        T.StructField("temp_min", T.DoubleType()),
        T.StructField("temp_max", T.DoubleType()),
        T.StructField("pressure", T.IntegerType()),
        T.StructField("humidity", T.IntegerType()),
        T.StructField("sea_level", T.IntegerType()),
        T.StructField("grnd_level", T.IntegerType()),
    ])),
    T.StructField("wind", T.StructType([
        T.StructField("speed", T.DoubleType()),
        T.StructField("deg", T.IntegerType()),
    ])),
    T.StructField("clouds", T.StructType([T.StructField("all", T.IntegerType())])),
])

RAW_WEATHER = T.StructType([
    T.StructField("camera_id", T.StringType()),
    T.StructField("slot", T.StringType()),
    *WEATHER_DOC.fields,
])

# With the instant the document was stored at, as text that sorts by time.
STORED_WEATHER = T.StructType([*RAW_WEATHER.fields, T.StructField("stored_at", T.StringType())])
