"""What the operators of this folder share: tables, stored steps, connected components."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.session import fresh_dir

#: Upper-case ASCII to lower case; every other character keeps its form and its place.
ASCII_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends here, and a lost
    executor costs no more than the tasks it ran."""
    path = fresh_dir(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """What runs inside hands Python so many rows at a time; the session's own number, which
    suits short rows, holds again afterwards."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def rows_of(batches: Iterator[pa.RecordBatch], limit: int = 512) -> Iterator[pa.RecordBatch]:
    """Small slices of the incoming batches, so that long texts are few at a time in Python."""
    for batch in batches:
        for start in range(0, batch.num_rows, limit):
            yield batch.slice(start, limit)


def arrow_schema(df_schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df_schema)


def lowered(text: str) -> str:
    """A-Z to a-z only."""
    return text.lower() if text.isascii() else text.translate(ASCII_LOWER)


#: Words of the license contract: digits, letters a-z and everything beyond ASCII.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def components(edges: DataFrame, label: str, most_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph given as (a, b) rows with a != b.

    Returns (id, component) for every id that occurs in an edge; component is the smallest
    id reachable. Alternates "large star" (each id's larger neighbours go to its smallest
    neighbour) and "small star" (its smaller ones do) until nothing changes; rounds grow
    with the logarithm of the longest path. The neighbours of one id are never gathered:
    the smallest is an aggregate that combines on the map side and joins back by id, where
    adaptive execution splits an id with very many neighbours. No null ids.
    """
    edges = stored(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(),
        f"{label}-edges",
    )
    seen = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (
            both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        )
        large = stored(large, f"{label}-large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        linked = large.join(least, "a")
        small = (
            linked.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
            .unionByName(least.select("a", F.col("m").alias("b")))
            .distinct()
        )
        edges = stored(small, f"{label}-small")
        now = edges.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
        ).first()
        if seen is not None and tuple(now) == seen:
            break
        seen = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("b").alias("id")).distinct()
    return edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component")).unionByName(
        roots.select("id", F.col("id").alias("component"))
    )
