"""Approximate nearest neighbours over learned partitions.

On a bounded sample the neighbour graph (largest inner products) is cut into balanced
parts, and a softmax classifier learns which part a vector's neighbours lie in. Every row
of the table goes to its most probable part; a query visits its several most probable
parts, where all rows are ranked exactly. How many parts it visits is measured on the
sample: the fewest that reach the wanted recall there.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from slotwise.llm.common import stored
from slotwise.llm.vectors import dimension, matrix, sampled, usable

#: Vectors the partition is learned from, at most.
SAMPLE = 4096
#: The largest number of parts; below it, the cube root of the rows.
MOST_PARTS = 256
#: Recall that the number of visited parts must reach on the sample.
RECALL = 0.96
#: Rows and queries that one task compares at a time, at most about so many. Parts that are
#: small are compared together, so that a query has one partial result for all of them.
ROW_BLOCK, BLOCK = 16_384, 4096


class Router(NamedTuple):
    weights: np.ndarray  # dimensions + 1 by parts
    probes: int

    def logits(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[:-1] + self.weights[-1]


def _neighbours(x: np.ndarray, k: int) -> np.ndarray:
    """The k rows with the largest inner products of each row, itself left out."""
    found = np.empty((len(x), k), dtype="int64")
    for start in range(0, len(x), 512):
        scores = x[start: start + 512] @ x.T
        scores[np.arange(len(scores)), start + np.arange(len(scores))] = -np.inf
        found[start: start + 512] = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    return found


def balanced_parts(graph: np.ndarray, x: np.ndarray, parts: int, rounds: int = 12) -> np.ndarray:
    """Parts of at most 5 % over equal size, with many edges inside: starting from slices
    along a direction of large spread, each round moves nodes to where most of their
    neighbours are, the surest first, while there is room."""
    n, rng = len(x), np.random.default_rng(7)
    room = int(np.ceil(1.05 * n / parts))
    centres = x[rng.choice(n, parts, replace=False)]
    owner = _assigned(x @ centres.T, room)
    for _ in range(rounds):
        votes = np.zeros((n, parts))
        np.add.at(votes, (np.repeat(np.arange(n), graph.shape[1]), owner[graph].ravel()), 1.0)
        np.add.at(votes, (graph.ravel(), np.repeat(owner, graph.shape[1])), 1.0)
        centres = np.stack([x[owner == p].mean(0) if (owner == p).any() else x[p] for p in range(parts)])
        moved = _assigned(votes + 0.5 * (x @ centres.T), room)
        if (moved == owner).all():
            break
        owner = moved
    return owner


def _assigned(gain: np.ndarray, room: int) -> np.ndarray:
    """Each row's best part that still has room, rows with the clearest choice first."""
    order = np.argsort(-gain, axis=1, kind="stable")
    best = np.take_along_axis(gain, order[:, :2], axis=1)
    lead = best[:, 0] - best[:, 1] if best.shape[1] > 1 else best[:, 0]
    free, owner = np.full(gain.shape[1], room), np.empty(len(gain), dtype="int64")
    for row in np.argsort(-lead, kind="stable"):
        part = next(p for p in order[row] if free[p])
        owner[row], free[part] = part, free[part] - 1
    return owner


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def learned(x: np.ndarray, parts: int, k: int, recall: float = RECALL) -> Router:
    """The router for ``parts`` parts; with one part it has nothing to learn."""
    n, dim = x.shape
    if parts <= 1 or n <= 2 * k:
        return Router(np.zeros((dim + 1, 1)), 1)
    near = _neighbours(x, min(k, n - 1))
    owner = balanced_parts(near, x, parts)
    targets = np.zeros((n, parts))
    np.add.at(targets, (np.repeat(np.arange(n), near.shape[1]), owner[near].ravel()), 1.0 / near.shape[1])
    targets = 0.5 * targets + 0.5 * np.eye(parts)[owner]
    inputs, scale = np.hstack([x, np.ones((n, 1))]), 1 / max(1e-12, float(np.sqrt((x * x).sum(1).mean())))
    inputs[:, :-1] *= scale
    weights, mean, square = np.zeros((dim + 1, parts)), 0.0, 0.0
    for step in range(1, 201):
        slope = inputs.T @ (_softmax(inputs @ weights) - targets) / n + 1e-4 * weights
        mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope**2
        weights -= 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    weights[:-1] *= scale
    router = Router(weights, 1)
    logits = router.logits(x)
    home, order = logits.argmax(1), np.argsort(-logits, axis=1, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(parts)[None, :], axis=1)
    reached = np.take_along_axis(rank, home[near], axis=1)
    probes = next(p for p in range(1, parts + 1) if (reached < p).mean() >= recall)
    return Router(weights, probes)


def _bundles(sizes: np.ndarray, most: int = ROW_BLOCK) -> np.ndarray:
    """Parts in their order, put together as long as they hold ``most`` rows in all."""
    bundle, held = np.zeros(len(sizes), dtype="int64"), 0
    for part, size in enumerate(sizes.tolist()):
        if held and held + size > most:
            bundle[part:] += 1
            held = 0
        held += size
    return bundle


def search(
    vectors: DataFrame, *, k: int = 20, every: int = 20, sample: int = SAMPLE, most_parts: int = MOST_PARTS,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """The ``k`` rows of largest inner product for each row whose id is divisible by ``every``.

    Returns query_id, rank (from 1), vec_id, score: nearest first, ties to the smaller id,
    the query's own rows left out. Fewer than ``k`` other rows in all: all of them. Vectors
    that are null, zero, of an unusual length or hold null or non-finite components, and
    rows without id, take no part; no usable query or an empty table: no rows. Rows that
    repeat an id are candidates each for other ids, and one query: that with the smallest
    digest of its vector. Other columns are not read.

    Small parts are compared together; a part that holds many rows (a very common vector,
    say) is split into blocks by hash, as are its queries, so that no task holds more than
    two blocks.
    """
    dim = dimension(vectors, vector_col)
    rows = stored(usable(vectors, dim, id_col=id_col, vector_col=vector_col), "ann-rows")
    n = rows.count()
    parts = int(max(1, min(most_parts, round(n ** (1 / 3)))))
    router = learned(sampled(rows, sample, dim), parts, k) if parts > 1 else Router(np.zeros((dim + 1, 1)), 1)

    @pandas_udf(T.IntegerType())
    def home(column: pd.Series) -> pd.Series:
        return pd.Series(router.logits(matrix(list(column), dim)).argmax(1).astype("int32"))

    placed = stored(rows.select("id", "vector", "digest", home("vector").alias("part")), "ann-placed")
    held = {r.part: r["count"] for r in placed.groupBy("part").count().collect()}  # one number per part
    asked = placed.where(F.col("id") % every == 0).groupBy("id").agg(F.min_by("vector", "digest").alias("vector"))
    if not held:
        return asked.select(
            F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")
        )
    sizes = np.array([held.get(p, 0) for p in range(router.weights.shape[1])])

    @pandas_udf(T.ArrayType(T.IntegerType()))
    def visited(column: pd.Series) -> pd.Series:
        order = np.argsort(-router.logits(matrix(list(column), dim)), axis=1, kind="stable")
        enough = (np.cumsum(sizes[order], axis=1) <= k).sum(1) + 1  # parts that hold k others at least
        return pd.Series([o[: max(router.probes, e)].astype("int32") for o, e in zip(order, enough, strict=True)])

    bundle = _bundles(sizes)  # one number per part, MOST_PARTS at most
    bundles = F.array(*[F.lit(int(b)) for b in bundle])
    of = lambda part: F.get(bundles, part)
    asked = asked.select("id", "vector", visited("vector").alias("visited")).select(
        "id", "vector", "visited", F.explode(F.array_distinct(F.transform("visited", of))).alias("bundle")
    )
    asked = stored(asked.withColumn("visited", F.filter("visited", lambda p: of(p) == F.col("bundle"))), "ann-asked")
    queries = {r.bundle: r["count"] for r in asked.groupBy("bundle").count().collect()}
    rows_of_bundle = np.bincount(bundle, sizes, bundle.max() + 1)
    blocks = asked.sparkSession.createDataFrame(
        [(int(b), int(-(-n // ROW_BLOCK)), -(-queries[b] // BLOCK)) for b, n in enumerate(rows_of_bundle) if n and b in queries],
        "bundle int, row_blocks int, query_blocks int",
    )
    # One row per bundle, no more than there are parts.
    own = placed.withColumn("bundle", of(F.col("part"))).join(F.broadcast(blocks), "bundle").select(
        "bundle", F.pmod(F.xxhash64("id"), "row_blocks").cast("int").alias("rb"),
        F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)).alias("qb"), "id", "part", "vector",
    )
    theirs = asked.join(F.broadcast(blocks), "bundle").select(
        "bundle", F.explode(F.sequence(F.lit(0), F.col("row_blocks") - 1)).alias("rb"),
        F.pmod(F.xxhash64("id"), "query_blocks").cast("int").alias("qb"), "id", "visited", "vector",
    )

    def best(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(r):
            r = r.sort_values("id", kind="stable")
            x, ids = matrix(list(r.vector), dim), r.id.to_numpy()
            y, asks = matrix(list(q.vector), dim), q.id.to_numpy()
            parts, of_row = np.unique(r.part.to_numpy(), return_inverse=True)
            open_ = np.array([np.isin(parts, np.asarray(v)) for v in q.visited])
            whole = open_.all()
            for start in range(0, len(y), 128):
                step = slice(start, start + 128)
                scores = y[step] @ x.T
                if not whole:
                    scores[~open_[step][:, of_row]] = -np.inf
                scores[ids[None, :] == asks[step, None]] = -np.inf
                least = np.full(len(scores), -np.inf)
                if len(ids) > k:
                    least = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
                least = least - 1e-9 * np.maximum(1.0, np.where(np.isfinite(least), np.abs(least), 1.0))
                for query, vector, row, bound in zip(asks[step], y[step], scores, least, strict=True):
                    near = np.flatnonzero((row >= bound) & (row > -np.inf))
                    # Summed the same way for every pair, so that equal vectors score equally.
                    exact = (x[near] * vector).sum(1)
                    chosen = np.argsort(-exact, kind="stable")[:k]
                    out.append((query, ids[near][chosen], exact[chosen]))
        return pd.DataFrame({
            "query_id": np.repeat([o[0] for o in out], [len(o[1]) for o in out]) if out else [],
            "vec_id": np.concatenate([o[1] for o in out]) if out else [], "score": np.concatenate([o[2] for o in out]) if out else [],
        })

    found = theirs.groupBy("bundle", "rb", "qb").cogroup(own.groupBy("bundle", "rb", "qb")).applyInPandas(
        best, "query_id long, vec_id long, score double"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
