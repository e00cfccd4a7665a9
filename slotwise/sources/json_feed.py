"""Raw JSON objects: each file is one record or an array of records."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from slotwise.functions.timekeys import camera_from_path, slot_from_path
from slotwise.session import path_exists
from slotwise.sources.json_ranges import array_records

# Fixed value: the suffix is matched in any case.
JSON_SUFFIX = "*.[jJ][sS][oO][nN]"
CORRUPT = "_corrupt_record"
#: Bytes of a file above which it is read in ranges.
SPLIT_ABOVE = 32 << 20
#: A separator of lines that no JSON text in UTF-8 holds, so that such a file is one line. Those in
#: UTF-16 or UTF-32 hold it behind each key and fall apart.
NO_LINE = "\x00:\x00"
#: How much older than the newest object a new one may be; longer than any tree is old.
MAX_AGE = "36500d"
_LISTED = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()),
    T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType()),
])


def list_json(spark: SparkSession, prefix: str, pattern: str = JSON_SUFFIX) -> DataFrame:
    """Every JSON object under a prefix, at any depth: path and length, in path order.

    The contents are not read. Spark lists large trees on the executors, but keeps the names
    of all files in the driver's file index.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    return files.load(prefix).select("path", "length").orderBy("path")


def note_new(spark: SparkSession, prefix: str, index: str, pattern: str = JSON_SUFFIX, max_age: str = MAX_AGE) -> StreamingQuery:
    """Add the objects that came since the last call to ``index``, a table of path and
    length, and stop; read it with :func:`noted`.

    Each object is noted once, also when a call is stopped and runs again. No content is
    read. The stream's checkpoint holds the names that are at most ``max_age`` older than
    the newest object, and an older newcomer is passed over: where objects keep the time of
    their upload, some days are enough, and the driver keeps no more names than that.
    """
    files = _each_new(spark, "binaryFile", _LISTED, pattern, max_age).load(prefix).select("path", "length")
    writer = files.writeStream.format("parquet").option("path", f"{index}/objects").option("checkpointLocation", f"{index}/checkpoint")
    return writer.trigger(availableNow=True).start()


def noted(spark: SparkSession, index: str) -> DataFrame:
    """All objects that :func:`note_new` found, in path order."""
    schema, path = "path string, length long", f"{index}/objects"
    if not path_exists(spark, f"{path}/_spark_metadata/0"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).orderBy("path")


def _each_new(spark: SparkSession, file_format: str, schema: T.StructType, pattern: str, max_age: str):
    reader = spark.readStream.format(file_format).schema(schema).option("maxFileAge", max_age)
    return reader.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)


def _as_text(kind: T.DataType) -> T.DataType:
    """The same shape with every leaf as text, which takes any JSON value."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _as_text(f.dataType)) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_as_text(kind.elementType))
    return T.StringType()


def _typed(column: Column, kind: T.DataType) -> Column:
    """Text leaves as their own type; one that cannot be read is NULL and costs only itself."""
    if isinstance(kind, T.StructType):
        fields = F.struct(*[_typed(column[f.name], f.dataType).alias(f.name) for f in kind.fields])
        return F.when(column.isNotNull(), fields)
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda item: _typed(item, kind.elementType))
    return column if isinstance(kind, T.StringType) else column.try_cast(kind)


def _loose(schema: T.StructType) -> T.StructType:
    return T.StructType([*_as_text(schema).fields, T.StructField(CORRUPT, T.StringType())])


def _lenient(reader):
    return reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)


def _whole(records: DataFrame, schema: T.StructType) -> DataFrame:
    """Records of files read whole, ``path``, and whether a file is no JSON at all."""
    nothing = F.lit(True)
    for name in schema.fieldNames():
        nothing = nothing & F.col(name).isNull()
    broken = nothing | F.try_parse_json(F.col(CORRUPT)).isNull()
    return records.select(
        *schema.fieldNames(), F.col("_metadata.file_path").alias("path"),
        (F.col(CORRUPT).isNotNull() & broken).alias("unreadable"),
    )


def _parsed(spark: SparkSession, prefix: str, schema: T.StructType, pattern: str, split_above: int) -> DataFrame:
    """Records with text leaves, ``path``, and whether it is no JSON at all."""
    text_leaves = _as_text(schema)
    reader = spark.read.format("json").schema(_loose(schema)).option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    # As one line, a file is parsed from memory: ``multiLine`` goes back to the file for each number of a text leaf.
    reader = _lenient(reader).option("lineSep", NO_LINE)
    whole = _whole(reader.load(prefix).where(F.col("_metadata.file_size") <= split_above), schema)
    listed = list_json(spark, prefix, pattern).where(F.col("length") > split_above)
    if listed.isEmpty():
        return whole
    # Files are told apart by their size; none is read both ways.
    pieces = array_records(spark, prefix, pattern, split_above)
    readable = F.col("whole") & F.try_parse_json(F.col("record")).isNotNull()
    # Behind an explode, later filters and fields share one parse of a record; else each has its own.
    parsed = F.explode(F.array(F.from_json("record", text_leaves)))
    split = pieces.select("path", (~readable).alias("unreadable"), parsed.alias("r")).select(
        *[F.col(f"r.{name}").alias(name) for name in schema.fieldNames()], "path", "unreadable"
    )
    return whole.unionByName(split)


def read_json(
    spark: SparkSession, prefix: str, schema: T.StructType, pattern: str = JSON_SUFFIX, split_above: int = SPLIT_ABOVE
) -> DataFrame:
    """All records under a prefix, with ``path``.

    Arrays become rows, ``[]`` gives none, and a file that is not JSON gives none either;
    :func:`unreadable_files` names it. A field of the wrong type is NULL, the rest of its
    record stays. ``{}`` gives a row of NULLs, which the cleaning operators drop.

    Files up to ``split_above`` bytes are read by one task each. Larger ones are arrays read
    in ranges by many; there a broken record costs only itself. Files are UTF-8, as JSON is;
    others are not read.
    """
    return _readable(_parsed(spark, prefix, schema, pattern, split_above), schema)


def _readable(parsed: DataFrame, schema: T.StructType) -> DataFrame:
    records = parsed.where(~F.col("unreadable"))
    return records.select(*[_typed(F.col(f.name), f.dataType).alias(f.name) for f in schema.fields], "path")


def stream_json(
    spark: SparkSession, prefix: str, schema: T.StructType, pattern: str = JSON_SUFFIX, max_age: str = MAX_AGE,
    per_trigger: int | None = None,
) -> DataFrame:
    """What :func:`read_json` gives, as a stream: a query with a checkpoint reads each file
    once, in the run that finds it. Each file is read by one task, whatever its size;
    ``max_age`` as in :func:`note_new`.
    """
    reader = _lenient(_each_new(spark, "json", _loose(schema), pattern, max_age)).option("multiLine", True)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return _readable(_whole(reader.load(prefix), schema), schema)


def unreadable_files(
    spark: SparkSession, prefix: str, schema: T.StructType, pattern: str = JSON_SUFFIX, split_above: int = SPLIT_ABOVE
) -> DataFrame:
    """The paths of the files of which :func:`read_json` could not read all as JSON."""
    return _parsed(spark, prefix, schema, pattern, split_above).where("unreadable").select("path").distinct()


def keyed_by_path(records: DataFrame) -> DataFrame:
    """Records whose camera and slot are named by their folder, not by their content."""
    return records.withColumn("camera_id", camera_from_path(F.col("path"))).withColumn(
        "slot", slot_from_path(F.col("path"))
    )


def write_json_arrays(df: DataFrame, path: str) -> None:
    """Each task's rows as one file that holds one JSON array.

    Spark's JSON writer has no array form; a task adds the brackets around its rows. The
    files end in ``.txt``: read them with a pattern such as ``part-*``.
    """

    def bracket(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lead = "["
        for batch in batches:
            if len(batch):
                lines = "," + batch["value"]
                lines.iloc[0] = lead + batch["value"].iloc[0]
                lead = ","
                yield lines.to_frame()
        yield pd.DataFrame({"value": ["[]" if lead == "[" else "]"]})

    rows = df.select(F.to_json(F.struct(*df.columns)).alias("value"))
    rows.mapInPandas(bracket, "value string").write.text(path)
