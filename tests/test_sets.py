import os
import random

from pyspark.sql import functions as F

from reviewloom import operators as op
from reviewloom.session import discard, stored

SCHEMA = "place bigint, a string, b int"


def test_compare_ordered(spark):
    left = spark.createDataFrame([(1, "x", 1), (2, "y", None), (3, "z", 3)], SCHEMA)
    right = spark.createDataFrame([(1, "x", 1), (2, "y", None), (3, "z", 4), (4, "n", 0)], SCHEMA)
    got = op.compare_ordered(left, right, "place")
    assert got.columns == ["place", "left_a", "left_b", "right_a", "right_b"]
    assert sorted(map(tuple, got.collect())) == [(3, "z", 3, "z", 4), (4, None, None, "n", 0)]
    assert op.compare_ordered(left, left, "place").count() == 0


def test_compare_unordered(spark):
    left = spark.createDataFrame([("x", 1), ("x", 1), ("y", None)], "a string, b int")
    right = spark.createDataFrame([(None, "y"), (1, "x"), (2, "z")], "b int, a string")
    got = sorted(map(tuple, op.compare_unordered(left, right).collect()))
    assert got == [("x", 1, 1, 0), ("z", 2, 0, 1)]
    assert op.compare_unordered(left, left).count() == 0


def test_agreement(spark):
    one = spark.createDataFrame([(1, "en"), (2, "es"), (3, "en")], "id int, lang string")
    two = spark.createDataFrame([(1, "en"), (2, "en"), (4, "es")], "id int, lang string")
    pairs = op.paired(one, two, "id", "lang")
    got = {(r.lang_a, r.lang_b): r.n for r in op.agreement(pairs, "lang_a", "lang_b").collect()}
    assert got == {("en", "en"): 1, ("es", "en"): 1, ("en", None): 1, (None, "es"): 1}


def test_renumber(spark):
    frame = spark.createDataFrame([(i * 3,) for i in range(25)], "app_id bigint")
    rows = sorted(op.renumber(frame, 10).collect())
    assert [(r.batch_id, r.row_no) for r in rows] == [(i // 10, i % 10) for i in range(25)]
    assert [r.eof for r in rows] == [False] * 20 + [True] * 5


def test_chunk_head_by_brute_force(spark):
    pick = random.Random(11)
    rows = [(key, pick.choice([None, 1]), pick.choice([None, "t", "u"]))
            for key in pick.sample(range(10 ** 9), 300)]
    frame = spark.createDataFrame(rows, "id bigint, x int, y string")
    got = sorted(r.id for r in op.chunk_head(frame, "id", 32, 5, ["x", "y"]).collect())
    ordered, want = sorted(rows, key=lambda row: row[0]), []
    for start in range(0, len(ordered), 32):
        whole = [r[0] for r in ordered[start:start + 32] if r[1] is not None and r[2] is not None]
        want += whole[:5]
    assert got == want


def test_reduced(spark):
    games = spark.createDataFrame([(i,) for i in (9, 3, 5, 7)], "app_id bigint")
    reviews = spark.range(40).select((F.col("id") % 10).alias("app_id"))
    assert sorted(r.app_id for r in op.reduced_games(games, 2).collect()) == [3, 5]
    assert sorted(r.app_id for r in op.reduced_reviews(games, reviews, 2).collect()) == [
        3, 3, 3, 3, 5, 5, 5, 5
    ]


def test_discarded_tables_are_gone(spark):
    kept, used = (stored(spark.range(10), label) for label in ("kept", "used"))
    discard(used)
    assert not os.path.exists(used.stored_at) and os.path.exists(kept.stored_at)
    assert kept.count() == 10
