import math
import random

import numpy as np
import pytest

from reviewloom import operators as op

STAT = "app_id bigint, name string, stat bigint"


def stats_frame(spark, stats):
    return spark.createDataFrame([(i, str(i), s) for i, s in stats], STAT)


def test_top_five_of_six(spark):
    frame = stats_frame(spark, [(1, 1), (2, 3), (3, 2), (4, 6), (5, 4), (6, 5)])
    assert [row.app_id for row in op.top_n(frame, 5).collect()] == [4, 6, 5, 2, 3]


def test_ties_go_to_the_smaller_key(spark):
    frame = stats_frame(spark, [(7, 10), (3, 10), (5, 10)])
    assert [row.app_id for row in op.top_n(frame, 2).collect()] == [3, 5]
    with pytest.raises(ValueError):
        op.top_n(frame, 0)


def test_top_of_tops_is_top(spark):
    pick = random.Random(3)
    stats = [(i, pick.randint(0, 30)) for i in range(200)]
    whole = op.top_n(stats_frame(spark, stats), 10).collect()
    parts = [op.top_n(stats_frame(spark, stats[i::3]), 10) for i in range(3)]
    assert op.top_n(op.union_partitions(parts), 10).collect() == whole
    plan = op.top_n(stats_frame(spark, stats), 10)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_top_per_group_is_cut_before_the_shuffle(spark):
    frame = spark.createDataFrame(
        [(c, i, (i * 7) % 11) for c in (1, 2) for i in range(40)],
        "client_id bigint, app_id bigint, stat bigint")
    top = op.top_n(frame, 3, by=("client_id",))
    assert sorted((r.client_id, r.app_id) for r in top.collect()) == [
        (1, 3), (1, 14), (1, 25), (2, 3), (2, 14), (2, 25)
    ]
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


KEYS = [
    list(range(50)),
    [i * 2 ** 20 for i in range(-5, 30)],
    [2 ** 63 - 1, -(2 ** 63), 0, -1, 1, 2 ** 40, 2 ** 41 - 1, -(2 ** 40), 2 ** 20 - 1, 2 ** 20],
]


@pytest.mark.parametrize("keys", KEYS)
@pytest.mark.parametrize("key_bits", [64, 40])
def test_running_total(spark, keys, key_bits):
    pick = random.Random(5)
    rows = [(key, pick.randint(0, 9)) for key in keys]
    pick.shuffle(rows)
    frame = spark.createDataFrame(rows, "k bigint, w bigint")
    got = {r.k: r.upto for r in op.running_total(frame, "k", "w", key_bits=key_bits).collect()}
    total, want = 0, {}
    for key, weight in sorted(rows):
        total += weight
        want[key] = total
    assert got == want
    places = {r.k: r.upto for r in op.running_total(frame, "k").collect()}
    assert places == {key: i + 1 for i, key in enumerate(sorted(keys))}


def test_running_total_per_group(spark):
    rows = [(g, k) for g in "ab" for k in range(0, 10 ** 7, 2 ** 20 - 1)]
    frame = spark.createDataFrame(rows, "g string, k bigint")
    for row in op.running_total(frame, "k", by=["g"]).collect():
        assert row.upto == row.k // (2 ** 20 - 1) + 1


def nearest_rank(stats, p):
    """(stat, key) rows kept, by sorting: equal stats keep the smallest keys."""
    ordered = sorted(stats, key=lambda s: (s[1], -s[0]))
    first = max(0, int(math.ceil(p / 100.0 * len(ordered))) - 1)
    return sorted(ordered[first:])


def kept(frame):
    return sorted((row.app_id, row.stat) for row in frame.collect())


def test_percentile_of_ten(spark):
    frame = stats_frame(spark, [(i, i) for i in range(1, 11)])
    assert kept(op.percentile_cut(frame, 90)) == [(9, 9), (10, 10)]
    assert kept(op.percentile_cut(frame, 90, method="linear")) == [(10, 10)]


def test_percentile_of_equal_counts(spark):
    frame = stats_frame(spark, [(i, 1) for i in range(1, 11)])
    assert kept(op.percentile_cut(frame, 90)) == [(1, 1), (2, 1)]
    assert len(kept(op.percentile_cut(frame, 90, ties="keep"))) == 10
    assert len(kept(op.percentile_cut(frame, 90, method="linear"))) == 10


def test_percentile_of_nothing(spark):
    frame = stats_frame(spark, [])
    for options in ({}, {"ties": "keep"}, {"method": "linear"}):
        assert kept(op.percentile_cut(frame, 90, **options)) == []


def test_percentile_options_are_checked(spark):
    frame = stats_frame(spark, [(1, 1)])
    with pytest.raises(ValueError):
        op.percentile_cut(frame, 90, method="other")
    with pytest.raises(ValueError):
        op.percentile_cut(frame, 90, ties="other")
    with pytest.raises(ValueError):
        op.percentile_cut(frame, 101)


@pytest.mark.parametrize("p", [0, 7, 14, 28, 50, 55, 90, 100])
def test_percentile_by_brute_force(spark, p):
    """All sizes at once, one group per size; with ties, and rounding of p * n."""
    pick = random.Random(p)
    groups = {n: [(i, pick.randint(1, 12)) for i in range(n)] for n in (1, 2, 9, 25, 50, 100, 200)}
    rows = [(n, i, stat) for n, stats in groups.items() for i, stat in stats]
    frame = spark.createDataFrame(rows, "g int, app_id bigint, stat bigint")

    def by_group(answer):
        got = {n: [] for n in groups}
        for row in answer.collect():
            got[row.g].append((row.app_id, row.stat))
        return {n: sorted(found) for n, found in got.items()}

    cut = by_group(op.percentile_cut(frame, p, by=["g"]))
    assert cut == {n: nearest_rank(stats, p) for n, stats in groups.items()}

    keep = by_group(op.percentile_cut(frame, p, by=["g"], ties="keep"))
    linear = by_group(op.percentile_cut(frame, p, by=["g"], method="linear"))
    for n, stats in groups.items():
        lowest = min(stat for _, stat in nearest_rank(stats, p))
        assert keep[n] == sorted(s for s in stats if s[1] >= lowest)
        edge = np.quantile([stat for _, stat in stats], p / 100.0)
        assert linear[n] == sorted(s for s in stats if s[1] >= edge)


def test_ascending(spark):
    frame = stats_frame(spark, [(2, 5), (1, 5), (3, 1)])
    assert [row.app_id for row in op.ascending(frame).collect()] == [3, 1, 2]


def test_grouped_top_n_of_many_rows(spark):
    """Large n: ranks are cut in lanes first, and ties still go to the smaller key."""
    frame = spark.range(20_000).selectExpr("id % 2 as client_id", "id as app_id", "id % 10 as stat")
    got = {(r["client_id"], r["app_id"]) for r in op.top_n(frame, 5000, by=("client_id",)).collect()}
    want = set()
    for client in (0, 1):
        rows = sorted(((-(i % 10), i) for i in range(20_000) if i % 2 == client))[:5000]
        want |= {(client, i) for _, i in rows}
    assert got == want
