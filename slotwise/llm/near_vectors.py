"""Near-duplicate embeddings by tiled comparison in principal-component order.

Unit vectors are turned so that the leading coordinates carry most of the spread. Vectors
of cosine t lie within sqrt(2 - 2t) of each other in every coordinate, so a grid of that
width over the first few coordinates leaves only pairs of neighbouring cells to compare.
Cells are cut into tiles of bounded size. Inside a pair of tiles the products of leading
coordinates are summed first; what the rest can add is bounded by the norms of the
suffixes, and pairs that cannot reach the threshold are dropped before the next step. Tiles
are ordered by the leading coordinate: rows of the other tile that lie too far off in it
are not looked at.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotwise.llm.common import arrow_schema, components, rows_of, stored
from slotwise.llm.vectors import dimension, matrix, sampled, usable

THRESHOLD = 0.98
#: Vectors the turn is computed from, at most; any turn gives the same links.
SAMPLE = 8192
#: Vectors of one tile, about; a cell with more is split by hash. A tile is sent to each
#: tile it meets, so larger tiles are sent less often.
TILE = 4096
#: Coordinates of the grid, at most, those added in each step of a comparison, and rows of a
#: tile that are compared at a time.
MOST_AXES, STEPS, ROWS = 8, (8, 16, 32), 128


def turn(x: np.ndarray) -> np.ndarray:
    """Orthonormal directions by falling variance, as columns."""
    return np.linalg.svd((x - x.mean(0)).T @ (x - x.mean(0)))[0]


def near_pairs(a: np.ndarray, b: np.ndarray, threshold: float, steps: tuple[int, ...] = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of ``a`` and ``b`` (unit vectors, turned) that may reach the
    threshold; pairs left out cannot."""
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6
    one, two = np.argsort(a[:, 0], kind="stable"), np.argsort(b[:, 0], kind="stable")
    leading, found = b[two, 0], []
    for start in range(0, len(one), ROWS):
        rows = one[start: start + ROWS]
        low = np.searchsorted(leading, a[rows[0], 0] - reach)
        high = np.searchsorted(leading, a[rows[-1], 0] + reach, side="right")
        if low < high:
            i, j = _reaching(a[rows], b[two[low:high]], threshold - 1e-9, steps)
            found.append((rows[i], two[low:high][j]))
    if not found:
        return np.empty(0, dtype="int64"), np.empty(0, dtype="int64")
    return tuple(np.concatenate(part) for part in zip(*found, strict=True))


def _reaching(a: np.ndarray, b: np.ndarray, need: float, steps: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs whose product may be ``need`` or more: leading coordinates first, the rest
    bounded by the norms of the suffixes."""
    dim = a.shape[1]
    cuts = [c for c in steps if c < dim] + [dim]
    first = cuts[0]
    partial = a[:, :first] @ b[:, :first].T
    rest = np.outer(np.linalg.norm(a[:, first:], axis=1), np.linalg.norm(b[:, first:], axis=1))
    i, j = np.nonzero(partial + rest >= need)
    partial = partial[i, j]
    for low, high in itertools.pairwise(cuts):
        partial = partial + np.einsum("ij,ij->i", a[i, low:high], b[j, low:high])
        bound = partial + np.linalg.norm(a[:, high:], axis=1)[i] * np.linalg.norm(b[:, high:], axis=1)[j]
        kept = bound >= need
        i, j, partial = i[kept], j[kept], partial[kept]
    return i, j


def _spanning(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A node and the smallest node reachable from it, for the nodes that are not smallest."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            node = np.flatnonzero(label != np.arange(n))
            return node, label[node]
        label = new


def link(
    vectors: DataFrame, *, threshold: float = THRESHOLD, sample: int = SAMPLE, tile: int = TILE,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """Links between vectors of equal label with cosine ``threshold`` or more.

    Returns one row per row of ``vectors``: vec_id, n_links (other rows linked directly),
    component_id (smallest id reachable, itself included), kept (vec_id = component_id).
    Rows with a null label or id, or whose vector is null, zero, of an unusual length or
    holds null or non-finite components, link with nothing: 0 links, their own id, kept
    (null id: null component, not kept). Equal vectors of one label are compared once and
    counted each; rows that repeat an id are counted each and share its links' component.
    An empty table gives no rows. Other columns are not read.
    """
    dim = dimension(vectors, vector_col)
    vectors = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"), F.col(label_col).alias("label")
    )
    rows = stored(
        usable(vectors.where("label is not null"), dim, id_col="vec_id", vector_col="embedding", keep=("label",)),
        "near-rows",
    )
    alike = rows.groupBy("label", "digest").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    copies = stored(rows.select("id", "label", "digest").join(alike, ["label", "digest"]).select("id", "rep", "copies"), "near-copies")
    distinct = rows.groupBy("label", "digest").agg(
        F.min("id").alias("id"), F.count("*").alias("copies"), F.first("vector").alias("vector")
    )
    linked = _linked(distinct, dim, threshold, sample, tile)
    reach = linked.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    # An id may stand for several vectors; copies and repeated ids join their vectors' links.
    edges = linked.where("b is not null").select("a", "b").unionByName(
        copies.where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    )
    parts = components(edges, "near")
    own = copies.join(reach, "rep", "left").select(
        "id", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")
    ).groupBy("id").agg(F.max("n_links").alias("n_links"))
    return (
        vectors.select("vec_id").join(own, F.col("vec_id") == own.id, "left").drop("id")
        .join(parts, F.col("vec_id") == parts.id, "left")
        .select(
            "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component", "vec_id").alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    )


def _linked(distinct: DataFrame, dim: int, threshold: float, sample: int, tile: int) -> DataFrame:
    """Rows (a, null, n): vector a's links inside one pair of tiles, weighed by copies; and
    rows (a, b, null) that join all vectors linked there: one per vector at most, however
    many links it has."""
    spark = distinct.sparkSession
    schema = T.StructType([T.StructField(k, T.LongType()) for k in ("a", "b", "n")])
    distinct = stored(distinct, "near-distinct")
    x = sampled(distinct, sample, dim) if dim else np.empty((0, 1))
    if not len(x):
        return spark.createDataFrame([], schema)
    basis = turn(x / np.linalg.norm(x, axis=1, keepdims=True))
    width = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6
    most = distinct.groupBy("label").count().agg(F.max("count").alias("n")).first().n
    axes = int(min(MOST_AXES, dim, max(0, round(math.log(max(1, most / tile), 3)))))

    fields = [*distinct.select("id", "label", "copies").schema.fields, T.StructField("cell", T.ArrayType(T.IntegerType(), False), False)]
    cell_schema = T.StructType([*fields, T.StructField("vector", T.BinaryType(), False)])
    arrow = arrow_schema(cell_schema)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, 4096):
            unit = matrix(batch.column(3).to_pylist(), dim)
            unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
            cells = np.floor(unit @ basis[:, :axes] / width).astype("int32")
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(3)), pa.array(cells.tolist(), arrow.field("cell").type), batch.column(3)],
                schema=arrow,
            )

    celled = stored(distinct.select("id", "label", "copies", "vector").mapInArrow(place, cell_schema), "near-cells")
    cells = celled.groupBy("label", "cell").agg(F.ceil(F.count("*") / tile).cast("int").alias("blocks"))
    tiled = celled.join(cells, ["label", "cell"]).withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))

    # Each tile meets itself, and each pair of tiles in neighbouring cells meets once.
    tiles = stored(cells.select("label", "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")), "near-tiles")
    ahead = [s for s in itertools.product((-1, 0, 1), repeat=axes) if s >= (0,) * axes]
    steps = F.array(*[F.array(*[F.lit(v) for v in s]).cast("array<int>") for s in ahead])
    shifted = tiles.withColumn("step", F.explode(steps)).withColumn(
        "other", F.zip_with("cell", "step", lambda c, s: c + s)
    )
    right = tiles.select(F.col("label"), F.col("cell").alias("other"), F.col("block").alias("other_block"))
    pairs = shifted.join(right, ["label", "other"]).where(
        (F.col("cell") != F.col("other")) | (F.col("block") <= F.col("other_block"))
    ).select("label", "cell", "block", "other", "other_block")
    pairs = stored(
        pairs.withColumn("pair", F.xxhash64("label", "cell", "block", "other", "other_block")), "near-pairs"
    )
    payload = ["id", "copies", "vector"]
    keys = ["label", "cell", "block"]
    left = tiled.join(pairs, keys).select("pair", *payload)
    second = pairs.where((F.col("cell") != F.col("other")) | (F.col("block") != F.col("other_block"))).select(
        "label", F.col("other").alias("cell"), F.col("other_block").alias("block"), "pair"
    )
    right = tiled.join(second, keys).select(*[F.col(k).alias(f"{k}_2") for k in ("pair", *payload)])

    def compare(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        same = two.empty  # a tile with itself
        x = matrix(list(one.vector), dim)
        y = x if same else matrix(list(two.vector_2), dim)
        nx, ny = np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1))
        i, j = near_pairs((x / nx[:, None]) @ basis, (y / ny[:, None]) @ basis, threshold)
        exact = (x[i] * y[j]).sum(1) / (nx[i] * ny[j])
        hit = (exact >= threshold) & ((i < j) if same else True)
        i, j = i[hit], j[hit] if same else j[hit] + len(one)
        ids, weight = one.id.to_numpy(), one.copies.to_numpy()
        if not same:
            ids, weight = np.concatenate([ids, two.id_2]), np.concatenate([weight, two.copies_2])
        n = np.bincount(i, weight[j], len(ids)) + np.bincount(j, weight[i], len(ids))
        linked = np.flatnonzero(n)
        node, root = _spanning(i, j, len(ids))
        frame = pd.concat([
            pd.DataFrame({"a": ids[linked], "b": pd.NA, "n": n[linked].astype("int64")}),
            pd.DataFrame({"a": ids[node], "b": ids[root], "n": pd.NA}),
        ])
        return frame.astype({"a": "Int64", "b": "Int64", "n": "Int64"})

    # A pair is named by a 64-bit hash of its two tiles.
    return stored(left.groupBy("pair").cogroup(right.groupBy("pair_2")).applyInPandas(compare, schema), "near-links")
