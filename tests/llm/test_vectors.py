"""Neighbour search and embedding links against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from slotwise.llm import ann, near_vectors, queries
from tests.llm import cases

SCHEMA = "vec_id long, embedding array<float>, label int"
ODD = [
    (901, None, 1), (902, [0.0] * 8, 1), (903, [None, *[1.0] * 7], 1), (904, [float("nan")] + [1.0] * 7, 1),
    (905, [float("inf")] + [1.0] * 7, 1), (906, [], 1), (907, [1.0] * 5, 1), (None, [1.0] * 8, 1), (908, [1.0] * 8, None),
]


def clusters(n=300, dim=8, seed=3, labels=3):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        v = rng.normal(size=dim)
        if k >= 40 and k % 3:
            v = np.array(rows[k % 40][1]) + rng.normal(size=dim) * rng.choice([0.0, 0.05, 0.2])
        rows.append((k, [float(np.float32(x)) for x in v], int(k % 40 % labels)))
    return rows


def links(rows, threshold=0.98):
    good = [(k, np.array(v, dtype="float64"), label) for k, v, label in rows]
    n, root = {k: 0 for k, *_ in rows}, {k: k for k, *_ in rows}
    for i, (a, x, la) in enumerate(good):
        for b, y, lb in good[:i]:
            if la == lb and (x * y).sum() / (math.sqrt((x * x).sum()) * math.sqrt((y * y).sum())) >= threshold:
                n[a] += 1
                n[b] += 1
                for _ in range(2):
                    low = min(root[a], root[b])
                    old = {root[a], root[b]}
                    root = {k: low if r in old else r for k, r in root.items()}
    return n, root


@pytest.mark.parametrize("tile", [16, 100, 1000])
def test_links(spark, tile):
    rows = clusters()
    df = spark.createDataFrame(rows + ODD, SCHEMA).withColumn("id", F.lit("x")).withColumn("n", F.lit("x")).repartition(3)
    found = near_vectors.link(df, tile=tile).collect()
    n, root = links(rows)
    assert len(found) == len(rows) + len(ODD)
    by = {r.vec_id: r for r in found}
    for k, *_ in rows:
        assert (by[k].n_links, by[k].component_id, by[k].kept) == (n[k], root[k], root[k] == k)
    for k, *_ in ODD:
        assert by[k].n_links == 0 and by[k].component_id == k and by[k].kept == (k is not None)
    assert near_vectors.link(df.limit(0)).count() == 0


def test_link_query_matches_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{cases.SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    n, root = links(rows)
    for r in queries.op8_near_vectors(spark, cases.SF).collect():
        assert (r.n_links, r.component_id, r.kept) == (n[r.vec_id], root[r.vec_id], root[r.vec_id] == r.vec_id)


def test_bounds_drop_no_pair():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(80, 20))
    b = np.vstack([a[:40] + 0.1 * rng.normal(size=(40, 20)), rng.normal(size=(40, 20))])
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b))
    i, j = near_vectors.near_pairs(a, b, 0.95, (4, 8))
    want = {(p, q) for p, q in zip(*np.nonzero(a @ b.T >= 0.95), strict=True)}
    assert want <= set(zip(i, j, strict=True)) and len(i) < 400


def exact(rows, k, every):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype="float64")
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        other = np.flatnonzero(ids != ids[q])
        scores = (x[other] * x[q]).sum(1)
        order = np.lexsort((ids[other], -scores))[:k]
        out[int(ids[q])] = [(int(ids[other][o]), float(scores[o])) for o in order]
    return out


def test_one_part_is_exact(spark):
    rows = [*clusters(), *[(500 + k, clusters()[5][1], 0) for k in range(30)]]  # ties
    df = spark.createDataFrame(rows + ODD[:-1], SCHEMA).withColumn("part", F.lit("x")).withColumn("score", F.lit("x"))
    found = ann.search(df, k=7, every=10, most_parts=1).collect()
    want = exact(rows, 7, 10)
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert {q: [k for k, _ in v] for q, v in got.items()} == {q: [k for k, _ in v] for q, v in want.items()}
    assert all(abs(a[1] - b[1]) < 1e-12 for q in want for a, b in zip(got[q], want[q], strict=True))


def test_recall_over_parts(spark):
    rng = np.random.default_rng(9)
    rows = [(k, [float(x) for x in rng.normal(size=8)], 0) for k in range(2000)]
    found = ann.search(spark.createDataFrame(rows, SCHEMA), k=10, every=20, sample=500, most_parts=12).collect()
    want = exact(rows, 10, 20)
    hits = sum(r.vec_id in {k for k, _ in want[r.query_id]} for r in found)
    assert len(found) == 1000 and hits >= 900
    for query in want:
        own = sorted((r for r in found if r.query_id == query), key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 11)) and all(a.score >= b.score for a, b in zip(own, own[1:], strict=False))


def test_parts_are_balanced():
    x = np.random.default_rng(2).normal(size=(400, 8))
    owner = ann.balanced_parts(ann._neighbours(x, 10), x, 8)
    assert np.bincount(owner, minlength=8).max() <= math.ceil(1.05 * 50)


def test_few_and_no_rows(spark):
    few = spark.createDataFrame([(k, [1.0, float(k)], 0) for k in range(4)], SCHEMA)
    found = ann.search(few).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in sorted(found, key=lambda r: r.rank)] == [(0, 1, 1), (0, 2, 2), (0, 3, 3)]
    assert ann.search(few.limit(0)).count() == 0 and ann.search(few.where("vec_id = 1")).count() == 0
    assert ann.search(spark.createDataFrame([(1, None, 0)], SCHEMA)).count() == 0


def test_search_query_recall(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{cases.SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want = exact(rows, 20, 20)
    found = queries.op7_learned_partitions(spark, cases.SF).collect()
    least = {q: v[-1][1] - 1e-12 for q, v in want.items()}
    assert sum(r.score >= least[r.query_id] for r in found) >= 0.9 * sum(map(len, want.values()))
