"""Hard negatives against all windows, one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewloom.llm import negatives

SCHEMA = "id bigint, label int, vector array<double>"


def brute_force(rows, every, n_pos=5, n_neg=5):
    usable = [(i, label, np.floor(256 * np.array(v)).astype(np.int64)) for i, label, v in rows
              if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, label, v in usable:
        if a % every:
            continue
        scored = sorted((-int(v @ w), i, other == label) for i, other, w in usable if i != a and len(v) == len(w))
        for score, p in [(-s, i) for s, i, same in scored if same][:n_pos]:
            inside = [(i, -s) for s, i, same in scored if not same and 80 * score <= -100 * s <= 100 * score]
            out += [(a, p, rank, i, score, s) for rank, (i, s) in enumerate(inside[:n_neg], 1)]
    return sorted(out)


def found(spark, rows, every, **options):
    whole = negatives.integer_rows(spark.createDataFrame(rows, SCHEMA).withColumn("v", F.lit("clash")).withColumn(
        "uppers", F.lit("clash")))
    got = negatives.hard_negatives(whole, whole.where(F.col("id") % every == 0), **options)
    return sorted(tuple(r) for r in got.collect())


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(negatives, "GROUP_BYTES", 1000)
    monkeypatch.setattr(negatives, "BLOCKS_PER_LANE", 2)
    monkeypatch.setattr(negatives, "TILE_ROWS", 3)


@pytest.mark.parametrize("n_pos, n_neg", [(5, 5), (3, 2), (1, 20)])
def test_against_all_windows(spark, small_blocks, n_pos, n_neg):
    """Near and equal vectors, so that scores tie; one label has a third of all rows."""
    rng = np.random.default_rng(n_neg)
    centres = rng.standard_normal((12, 8))
    vectors = centres[rng.integers(0, 12, 500)] + rng.standard_normal((500, 8)) * rng.choice([0, 0.1, 0.5], (500, 1))
    labels = np.where(rng.random(500) < 0.33, 0, rng.integers(0, 9, 500))
    rows = [(i, int(label), v.tolist()) for i, (label, v) in enumerate(zip(labels, vectors))]
    got = found(spark, rows, 10, positives=n_pos, negatives=n_neg)
    assert got == brute_force(rows, 10, n_pos, n_neg)
    assert len(got) > 50


def test_edge_cases(spark, small_blocks):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 2.0]), (1, 1, None), (2, 1, [nan, 1.0]), (3, 2, [inf, 0.0]), (4, 1, [None, 1.0]), (5, 1, []),
            (6, 1, [1.0, 2.0]), (7, 1, [-1.0, -2.0]), (8, 2, [0.0, 0.0]), (9, 2, [1.0]), (10, 1, [3.0]), (11, 1, [1.0]),
            (12, None, [1.0, 2.0]), (None, 1, [1.0, 1.0]), (13, 2, [1.0, 2.0]), (14, 2, [0.9, 1.9]), (15, 1, [0.0, 0.0])]
    assert found(spark, rows, 1) == brute_force(rows, 1)
    assert found(spark, [], 1) == []
    assert found(spark, rows, 1000) == brute_force(rows, 1000)
    large = [(i, i % 2, [float(i) * 1e5, 1e5 * (i % 3)]) for i in range(8)]
    assert found(spark, large, 1) == brute_force(large, 1)


def test_repeated_ids(spark):
    rows = [(0, 1, [1.0]), (0, 1, [1.0]), (1, 1, [2.0]), (1, 1, [2.0]), (2, 3, [2.0]), (2, 3, [2.0]), (3, 3, [1.7])]
    want = [(0, 1, rank, n, 131072, s) for rank, n, s in ((1, 2, 131072), (2, 2, 131072), (3, 3, 111360))]
    assert found(spark, rows, 100) == sorted(2 * want)


def test_best_of():
    rng = np.random.default_rng(1)
    keys, scores, ids = rng.integers(0, 9, 300), rng.integers(0, 5, 300), rng.permutation(300)
    got = negatives.best_of(keys, scores, ids, 4)
    want = [x for key in range(9) for x in sorted(np.flatnonzero(keys == key), key=lambda i: (-scores[i], ids[i]))[:4]]
    assert list(got) == want
