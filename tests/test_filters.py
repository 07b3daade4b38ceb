import pytest
from pyspark.sql import functions as F

from reviewloom import operators as op


def ids(frame, key="app_id"):
    return sorted(row[key] for row in frame.collect())


@pytest.fixture
def tagged(games):
    return games(
        (1, "a", ["Indie"]), (2, "b", ["indie"]), (3, "c", ["Indie Rock"]),
        (4, "d", ["RPG", " Indie"]), (5, "e", ["Action"]), (6, "f", []),
    )


def test_genre(tagged):
    assert ids(op.by_genre(tagged, "Indie")) == [1]
    assert ids(op.by_genre(tagged, "Indie", match="substring")) == [1, 2, 3, 4]
    with pytest.raises(ValueError):
        op.by_genre(tagged, "Indie", match="other")


def test_decade(spark):
    frame = spark.createDataFrame(
        [(2009, "Jan 1, 2009"), (2010, "Feb 2010"), (2019, "Mar 2019"), (2020, "Apr 2020"),
         (1201, "May 1201")], "release_year int, release_date string")
    assert ids(op.by_decade(frame, 2010), "release_year") == [1201, 2010, 2019]
    by_text = op.by_decade(frame, 2010, date_text="release_date")
    assert ids(by_text, "release_year") == [1201, 2010, 2019]


def test_polarity(reviews):
    frame = reviews({(1, 1): 1, (2, -1): 1, (3, 0): 1, (4, 7): 1})
    assert ids(op.by_polarity(frame, "positive")) == [1]
    assert ids(op.by_polarity(frame, "negative")) == [2, 3, 4]
    assert ids(op.by_polarity(frame, "negative", "minus_one")) == [2]
    with pytest.raises(ValueError):
        op.by_polarity(frame, "mixed")
    with pytest.raises(ValueError):
        op.by_polarity(frame, "negative", "other")


def test_threshold_is_strict(spark):
    stats = spark.createDataFrame([(1, 4), (2, 5), (3, 6)], "app_id bigint, stat bigint")
    assert ids(op.over_count(stats, 5)) == [3]


def test_non_empty(spark):
    stats = spark.createDataFrame(
        [(1, "a", 1), (2, "", 1), (3, None, 1), (4, "d", 0)],
        "app_id bigint, name string, stat bigint")
    assert ids(op.non_empty(stats)) == [1]


def test_costly_condition_stays_behind_the_join(spark):
    texts = spark.createDataFrame([(1, "x"), (2, "y")], "id bigint, text string")
    scores = spark.createDataFrame([(1, 1), (2, -1)], "id bigint, score tinyint")
    costly = F.regexp_replace("text", "y", "z") == "z"
    joined = texts.join(scores, "id").filter(op.only_if(op.is_polarity("negative"), costly))
    assert ids(joined, "id") == [2]
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Join"):].split("\n", 1)[1]
    assert "regexp_replace" not in below


def test_routing(spark, tagged):
    routes = {
        "i": F.array_contains("genres", "Indie"),
        "any": F.size("genres") > 0,
        "none": F.lit(False),
    }
    rows = sorted((row.app_id, row.route) for row in op.route(tagged, routes).collect())
    assert rows == [(1, "any"), (1, "i"), (2, "any"), (3, "any"), (4, "any"), (5, "any")]
    counts = {row.route: row.n for row in op.route_counts(tagged, routes).collect()}
    assert counts == {"i": 1, "any": 5}
    assert {name: frame.count() for name, frame in op.routed(tagged, routes).items()} == {
        "i": 1, "any": 5, "none": 0
    }


def test_co_located_join_does_not_shuffle_again(spark):
    left = spark.range(1000).withColumnRenamed("id", "k")
    right = spark.range(500, 1500).withColumnRenamed("id", "k").withColumn("v", F.col("k") * 2)
    a, b = op.co_located([left, right], "k", 4)
    joined = a.hint("merge").join(b, "k")
    assert joined.count() == 500
    assert joined._jdf.queryExecution().executedPlan().toString().count("hashpartitioning") == 2


def test_negative_keys_have_a_bucket(spark):
    frame = spark.createDataFrame([(-7,), (7,)], "app_id bigint")
    counts = {row.bucket: row.n for row in op.bucket_counts(frame, "app_id", 3).collect()}
    assert counts == {0: 1, 2: 1}


def test_stage_counts_and_complete_rows(spark):
    frame = spark.createDataFrame([(1, "a"), (2, None), (None, "c")], "x int, y string")
    stages = {"all": F.lit(True), "x": F.col("x").isNotNull(), "none": F.col("x") > 9}
    assert {r.stage: r.n for r in op.stage_counts(frame, stages).collect()} == {
        "all": 3, "x": 2, "none": 0
    }
    assert op.complete_rows(frame, ["x", "y"]).collect() == [(1, "a")]
    assert op.complete_rows(frame, ["y"]).count() == 2
