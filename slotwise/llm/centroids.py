"""Centroid clustering in whole numbers, nearest centroids by the threshold algorithm.

Per component the centroids stand in a sorted list. From a vector's value the lists are
walked outward, one centroid of each component at a time; every centroid that is met gets
its exact distance. The squared distances at the frontiers add up to a bound on whatever
has not been met: when that sum is strictly larger than the best exact distance, no other
centroid can be nearer, nor as near.

Each round is one scan of the stored vectors; per partition and centroid it hands on the
sum of the components and their count, which Spark adds up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotwise.llm.common import arrow_schema, rows_of, stored

DIM, CLUSTERS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, 3
#: Largest whole component: the squares of so large differences still add up to a long.
LARGEST = 1 << 27
BATCH = 4096


def whole_vectors(df: DataFrame, *, dim: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector) of the rows that take part, components as little-endian longs."""
    schema = T.StructType([T.StructField("vec_id", df.schema[id_col].dataType), T.StructField("vector", T.BinaryType(), False)])
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, BATCH):
            lists = batch.column(1)
            lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            rows = np.flatnonzero(lengths == dim)
            flat = lists.take(pa.array(rows)).flatten()
            values = flat.to_numpy(zero_copy_only=False).astype("<f8").reshape(-1, dim)  # null gives NaN
            fits = np.isfinite(values).all(axis=1)
            scaled = np.floor(np.where(fits[:, None], values, 0.0) * scale)
            fits &= (np.abs(scaled) <= LARGEST).all(axis=1)
            if fits.any():
                vectors = [row.tobytes() for row in scaled[fits].astype("<i8")]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows[fits])), pa.array(vectors, arrow.field("vector").type)], schema=arrow
                )

    columns = [F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")]
    return df.select(*columns).mapInArrow(run, schema)


class Lists:
    """The centroids (rows of whole numbers), and per component their values in order."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.order = np.argsort(centroids, axis=0, kind="stable").T  # component, place -> centroid
        self.values = np.take_along_axis(centroids, self.order.T, axis=0).T

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Per vector its centroid (on a tie the smaller number) and squared distance; and
        how many exact distances were computed in all."""
        n, (count, dim) = len(vectors), self.centroids.shape
        best, found, exact = np.full(n, -1), np.full(n, np.iinfo(np.int64).max), 0
        met = np.zeros((n, count), dtype=bool)
        # Places of the next centroid below and above each value.
        above = np.empty((n, dim), dtype=np.int64)
        for d in range(dim):
            above[:, d] = np.searchsorted(self.values[d], vectors[:, d])
        below = above - 1
        active, component = np.arange(n), np.arange(dim)[None, :]
        far = np.iinfo(np.int64).max
        for _ in range(count):
            own, lo, hi = vectors[active], below[active], above[active]
            down = np.where(lo >= 0, own - self.values[component, np.maximum(lo, 0)], far)
            up = np.where(hi < count, self.values[component, np.minimum(hi, count - 1)] - own, far)
            goes_down = down <= up
            place = np.where(goes_down, lo, hi)
            frontier = np.minimum(down, up)
            below[active], above[active] = lo - goes_down, hi + ~goes_down
            fresh = np.zeros((len(active), count), dtype=bool)
            fresh[np.arange(len(active))[:, None], self.order[component, place]] = True
            fresh &= ~met[active]
            met[active] |= fresh
            for c in range(count):
                rows = np.flatnonzero(fresh[:, c])
                if len(rows):
                    exact += len(rows)
                    difference = own[rows] - self.centroids[c]
                    distance = np.einsum("ij,ij->i", difference, difference)
                    at = active[rows]
                    nearer = (distance < found[at]) | ((distance == found[at]) & (c < best[at]))
                    best[at[nearer]], found[at[nearer]] = c, distance[nearer]
            open_ = np.einsum("ij,ij->i", frontier, frontier) <= found[active]
            active = active[open_]
            if not len(active):
                break
        return best, found, exact


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<i8").reshape(-1, dim)


def _moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floors of their vectors' means, empty ones as before."""
    count, dim = centroids.shape
    schema = T.StructType([
        T.StructField("cluster", T.IntegerType(), False), T.StructField("component", T.IntegerType(), False),
        T.StructField("total", T.LongType(), False), T.StructField("n", T.LongType(), False),
    ])
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = Lists(centroids)
        totals, n = np.zeros((count, dim), dtype=np.int64), np.zeros(count, dtype=np.int64)
        for batch in rows_of(batches, BATCH):
            own = _matrix(batch.column(0), dim)
            best, _, _ = lists.nearest(own)
            for c in np.unique(best):
                members = own[best == c]
                totals[c] += members.sum(axis=0)
                n[c] += len(members)
        used = np.flatnonzero(n)
        if len(used):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(used, dim).astype("int32")), pa.array(np.tile(np.arange(dim, dtype="int32"), len(used))),
                 pa.array(totals[used].ravel()), pa.array(np.repeat(n[used], dim))], schema=arrow,
            )

    sums = vectors.select("vector").mapInArrow(run, schema).groupBy("cluster", "component").agg(
        F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")
    )
    moved = centroids.copy()
    for r in sums.collect():  # centroids times components rows at most
        moved[r.cluster, r.component] = int(r.total) // r.n
    return moved


def _assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    dim = centroids.shape[1]
    schema = T.StructType([
        vectors.schema["vec_id"], T.StructField("cluster", T.IntegerType(), False), T.StructField("distance", T.LongType(), False),
    ])
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = Lists(centroids)
        for batch in rows_of(batches, BATCH):
            best, found, _ = lists.nearest(_matrix(batch.column(1), dim))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best.astype("int32")), pa.array(found)], schema=arrow)

    return vectors.select("vec_id", "vector").mapInArrow(run, schema)


def first_centroids(vectors: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The vectors with the smallest hashes of ``seed:id``, in the order of the hashes."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null")))
    first = vectors.orderBy(F.sha2(name.cast("binary"), 256), "vector").limit(clusters).select("vector").collect()
    return np.array([np.frombuffer(bytes(r.vector), dtype="<i8") for r in first], dtype=np.int64)


def cluster(
    df: DataFrame, *, clusters: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """The cluster of each vector: vec_id, cluster, distance, cluster_inertia, inertia,
    centroid_sha256; one row per vector that takes part.

    Components become floor(scale * x). Left out are vectors that are null, of another
    length than ``dim``, that hold null or non-finite components, or one beyond 2^27 after
    scaling, whose distance might not fit a long. Zero vectors take part. Repeated ids are
    vectors of their own; a null id is hashed as the word ``null``; equal hashes are ordered
    by the vectors. Fewer vectors than ``clusters``: as many centroids as vectors. Equal
    centroids: the smaller number takes the vectors, the other stays empty and in its place.
    An empty table gives no rows. Other columns are not read.
    """
    schema = T.StructType([
        T.StructField("vec_id", df.schema[id_col].dataType), T.StructField("cluster", T.IntegerType()),
        *(T.StructField(name, T.LongType()) for name in ("distance", "cluster_inertia", "inertia")),
        T.StructField("centroid_sha256", T.StringType()),
    ])
    spark = df.sparkSession
    vectors = stored(whole_vectors(df, dim=dim, scale=scale, id_col=id_col, vector_col=vector_col), "centroid-vectors")
    centroids = first_centroids(vectors, clusters, seed)
    if not len(centroids):
        return spark.createDataFrame([], schema)
    for _ in range(rounds):
        moved = _moved(vectors, centroids)
        if (moved == centroids).all():
            break  # every further round would give the same
        centroids = moved
    assigned = stored(_assigned(vectors, centroids), "centroid-clusters")
    # One row per centroid from here on.
    sums = {r.cluster: r.s for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    rows = [
        (c, s, sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest())
        for c, s in sums.items()
    ]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(about), "cluster").select(*schema.fieldNames())


def _oracle() -> str:
    """The rounds as common table expressions, one row per vector and component."""
    steps = []
    for k in range(ROUNDS + 1):
        steps.append(f"""
far{k} AS (SELECT v.r, c.c, sum((v.x - c.x) * (v.x - c.x)) AS d FROM v JOIN c{k} c ON v.k = c.k GROUP BY v.r, c.c),
near{k} AS MATERIALIZED (
  SELECT r, c, d FROM far{k} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)""")
        if k < ROUNDS:
            steps.append(f"""
sums{k} AS (SELECT n.c, v.k, sum(v.x) AS s, count(*) AS n FROM near{k} n JOIN v ON n.r = v.r GROUP BY n.c, v.k),
c{k + 1} AS MATERIALIZED (
  SELECT c.c, c.k, CASE WHEN s.n IS NULL THEN c.x ELSE CAST((s.s - ((s.s % s.n) + s.n) % s.n) // s.n AS BIGINT) END AS x
  FROM c{k} c LEFT JOIN sums{k} s ON c.c = s.c AND c.k = s.k)""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, embedding FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIM}),
v AS MATERIALIZED (
  SELECT r, k, CAST(floor({SCALE} * CAST(embedding[k] AS DOUBLE)) AS BIGINT) AS x FROM kept, range(1, {DIM + 1}) AS t(k)),
seeds AS (
  SELECT r, row_number() OVER (ORDER BY sha256('{SEED}:' || CAST(vec_id AS VARCHAR))) - 1 AS c FROM kept
  QUALIFY c < {CLUSTERS}),
c0 AS MATERIALIZED (SELECT s.c, v.k, v.x FROM seeds s JOIN v ON s.r = v.r),{','.join(steps)},
digest AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY k)) AS h FROM c{ROUNDS} GROUP BY c)
SELECT kept.vec_id, CAST(n.c AS INTEGER) AS cluster, CAST(n.d AS BIGINT) AS distance,
       CAST(sum(n.d) OVER (PARTITION BY n.c) AS BIGINT) AS cluster_inertia, CAST(sum(n.d) OVER () AS BIGINT) AS inertia,
       digest.h AS centroid_sha256
FROM near{ROUNDS} n JOIN kept ON n.r = kept.r JOIN digest ON n.c = digest.c
"""


ORACLE = _oracle()
