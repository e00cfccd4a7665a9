"""Embedding columns as matrices."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotwise.llm.common import arrow_schema, rows_of


def matrix(vectors: list[bytes], dim: int) -> np.ndarray:
    """Rows of little-endian doubles."""
    return np.frombuffer(b"".join(vectors), dtype="<f8").reshape(-1, dim)


def dimension(df: DataFrame, vector_col: str) -> int:
    """The most frequent length of the vectors, the larger one on a tie; 0 without any."""
    sizes = df.where(F.col(vector_col).isNotNull()).groupBy(F.size(vector_col).alias("d")).count()
    row = sizes.where("d > 0").orderBy(F.desc("count"), F.desc("d")).first()
    return row.d if row else 0


def usable(df: DataFrame, dim: int, *, id_col: str, vector_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose vector can be compared, as id, ``keep``, vector (doubles) and digest.

    Left out: null ids; vectors that are null, zero, of another length than ``dim``, or that
    hold null or non-finite components.
    """
    fields = [T.StructField("id", T.LongType(), False), *(T.StructField(k, df.schema[k].dataType) for k in keep)]
    schema = T.StructType([*fields, T.StructField("vector", T.BinaryType(), False), T.StructField("digest", T.BinaryType(), False)])
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, 4096):
            rows, vectors, digests = [], [], []
            for row, values in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if values is None or len(values) != dim or None in values or not batch.column(0)[row].is_valid:
                    continue
                vector = np.array(values, dtype="<f8")
                if np.isfinite(vector).all() and vector.any():
                    rows.append(row)
                    vectors.append(vector.tobytes())
                    digests.append(hashlib.md5(vectors[-1], usedforsecurity=False).digest())
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).take(pa.array(rows)) for k in range(batch.num_columns - 1)),
                     pa.array(vectors, arrow.field("vector").type), pa.array(digests, arrow.field("digest").type)],
                    schema=arrow,
                )

    return df.select(
        F.col(id_col).cast("long").alias("id"), *keep, F.col(vector_col).cast("array<double>").alias("vector")
    ).mapInArrow(run, schema)


def sampled(rows: DataFrame, size: int, dim: int) -> np.ndarray:
    """At most ``size`` vectors, those whose ids have the smallest hashes."""
    found = rows.select("id", "vector").orderBy(F.xxhash64("id"), "id").limit(size).select("vector").collect()
    return matrix([bytes(r.vector) for r in found], dim)
