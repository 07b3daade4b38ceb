"""Exact top-k search against all products."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewloom.llm import retrieval

SCHEMA = "id bigint, vector array<double>"


def brute_force(rows, every, k=5):
    usable = [(i, np.floor(256 * np.array(v)).astype(np.int64)) for i, v in rows
              if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in usable:
        if q % every == 0:
            scores = sorted((-int(a @ b), i) for i, b in usable if i != q and len(a) == len(b))[:k]
            out += [(q, rank, i, -score) for rank, (score, i) in enumerate(scores, 1)]
    return sorted(out)


def found(spark, rows, every, **options):
    vectors = retrieval.integer_vectors(spark.createDataFrame(rows, SCHEMA).withColumn("v", F.lit("clash")))
    got = retrieval.top_k(vectors, vectors.where(F.col("id") % every == 0), **options)
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("spread", [0.0, 1.5])
def test_against_all_products(spark, spread):
    """Lengths alike and very unlike, groups of near and equal vectors."""
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((20, 24))
    vectors = centres[rng.integers(0, 20, 700)] + rng.standard_normal((700, 24)) * rng.choice([0, 0.1, 1], (700, 1))
    vectors *= np.exp(spread * rng.standard_normal((700, 1)))
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    assert found(spark, rows, 10, block_rows=64) == brute_force(rows, 10)
    assert found(spark, rows, 50) == brute_force(rows, 50)


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [nan, 1.0]), (3, [inf, 0.0]), (4, [None, 1.0]), (5, []), (6, [1.0, 2.0]),
            (7, [-1.0, -2.0]), (8, [0.0, 0.0]), (9, [1.0]), (10, [3.0]), (None, [1.0, 1.0]), (20, [0.5, -0.001])]
    assert found(spark, rows, 1) == brute_force(rows, 1)
    assert found(spark, [], 1) == []
    large = [(i, [float(i) * 1e6, -1e6 * (i % 3)]) for i in range(8)]
    assert found(spark, large, 1) == brute_force(large, 1)


def test_repeated_ids(spark):
    rows = [(0, [1.0]), (0, [1.0]), (1, [2.0]), (1, [2.0]), (2, [1.0])]
    got = found(spark, rows, 2)
    assert [g for g in got if g[0] == 0] == [(0, 1, 1, 512 * 256), (0, 2, 1, 512 * 256), (0, 3, 2, 256 * 256)]


def test_pruning_loses_nothing():
    rng = np.random.default_rng(2)
    vectors = rng.integers(-200, 200, (600, 16))
    vectors = vectors[np.argsort(-(vectors ** 2).sum(1))]
    queries = np.concatenate((vectors[::30], vectors[::30] // 2))
    ids = np.arange(600)
    want = retrieval.search_block(np.full(len(queries), -1), queries, np.full(len(queries), -np.inf), ids, vectors, 3)
    reach = np.array([-best[-1][0] for best in want], float)
    got = retrieval.search_block(np.full(len(queries), -1), queries, reach, ids, vectors, 3, bucket_rows=50, focus=6)
    assert got == want
