"""Centroid clustering against its SQL and a plain reading in Python's whole numbers."""

import hashlib
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from slotwise.llm import centroids
from tests.llm import cases
from tools.check import compare

SCHEMA = "vec_id long, embedding array<double>, label int"


def plainly(rows, clusters=8, rounds=10, dim=64, scale=1024):
    kept = [
        (i, [math.floor(scale * x) for x in v]) for i, v in rows
        if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)
    ]
    name = [(hashlib.sha256(f"3:{'null' if i is None else i}".encode()).hexdigest(), k) for k, (i, _) in enumerate(kept)]
    middle = [kept[k][1] for _, k in sorted(name)[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), c) for c, m in enumerate(middle))

    for _ in range(rounds):
        groups = [[] for _ in middle]
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        middle = [[sum(x) // len(g) for x in zip(*g, strict=True)] if g else m for g, m in zip(groups, middle, strict=True)]
    out = [(i, *reversed(nearest(v))) for i, v in kept]
    inertia = {c: sum(d for _, k, d in out if k == c) for _, c, _ in out}
    digest = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in middle]
    return sorted((str(i), c, d, inertia[c], sum(inertia.values()), digest[c]) for i, c, d in out)


def got(df):
    return sorted((str(r[0]), *r[1:]) for r in df.collect())


def test_query_has_the_rows_of_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{cases.SF}/embeddings.parquet'")
    same, text, _ = compare(spark, con, "op13_centroids", cases.SF, entry.queries(), entry.oracle_sql())
    assert same, text


def vectors(n, dim, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(6, dim))
    return [(k, [float(np.round(x, 3)) for x in middles[k % 6] + spread * rng.normal(size=dim)]) for k in range(n)]


@pytest.mark.parametrize("n, dim, clusters, rounds, spread", [(200, 4, 8, 10, 0.3), (60, 64, 8, 10, 1.0), (40, 2, 30, 3, 0.1), (5, 3, 8, 10, 1.0)])
def test_plain_reading(spark, n, dim, clusters, rounds, spread):
    rows = vectors(n, dim, n, spread)
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA).repartition(3)
    assert got(centroids.cluster(df, dim=dim, clusters=clusters, rounds=rounds)) == plainly(rows, clusters, rounds, dim)


def test_awkward_rows(spark):
    good = vectors(30, 4, 1)
    rows = [
        *good, (900, None), (901, []), (902, [1.0] * 5), (903, [None, 1.0, 1.0, 1.0]), (904, [float("nan"), 1.0, 1.0, 1.0]),
        (905, [1.0, float("-inf"), 1.0, 1.0]), (906, [0.0] * 4), (3, good[3][1]), (3, good[3][1]), (None, [0.5, -0.5, 0.25, 0.0]),
        (907, [-0.0004, 0.0004, -1.0, 1.0]),
    ]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA)
    df = df.select("*", *[F.lit("x").alias(c) for c in ("cluster", "distance", "vector", "inertia", "n")])
    assert got(centroids.cluster(df, dim=4)) == plainly(rows, dim=4)
    assert got(centroids.cluster(df.repartition(5), dim=4)) == plainly(rows, dim=4)
    assert centroids.cluster(df.limit(0), dim=4).count() == 0
    assert centroids.cluster(df.where("vec_id = 900"), dim=4).count() == 0
    assert centroids.cluster(df.where("vec_id = 900"), dim=4).columns == centroids.cluster(df, dim=4).columns
    huge = spark.createDataFrame([(1, [1e300, 0.0, 0.0, 0.0], 1), (2, [131072.0, -131072.0, 0.0, 0.0], 1)], SCHEMA)
    assert [r.vec_id for r in centroids.cluster(huge, dim=4).collect()] == [2]


def test_equal_vectors_leave_centroids_empty(spark):
    rows = [(k, [1.0, 2.0]) for k in range(20)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA)
    out = got(centroids.cluster(df, dim=2))
    assert out == plainly(rows, dim=2) and {r[1] for r in out} == {0}


@pytest.mark.parametrize("count, dim", [(1, 1), (2, 3), (40, 2), (64, 5), (8, 64)])
def test_nearest_is_the_first_of_the_nearest(count, dim):
    rng = np.random.default_rng(count)
    middles, own = rng.integers(-6, 7, (count, dim)), rng.integers(-8, 9, (300, dim))
    best, found, _ = centroids.Lists(middles).nearest(own)
    every = ((own[:, None, :] - middles[None]) ** 2).sum(axis=2)
    assert (best == every.argmin(axis=1)).all() and (found == every.min(axis=1)).all()


def test_walks_stop_early():
    rng = np.random.default_rng(1)
    middles = rng.integers(-100_000, 100_000, (500, 3))
    own = middles[rng.integers(0, 500, 1000)] + rng.integers(-50, 50, (1000, 3))
    _, _, exact = centroids.Lists(middles).nearest(own)
    assert exact < 0.05 * 500 * 1000
