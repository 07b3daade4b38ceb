import pytest
from pyspark.sql import functions as F

from reviewloom import operators as op
from reviewloom import plans
from reviewloom.sources import save_bucketed


def rows(frame):
    return sorted(tuple(row) for row in frame.collect())


SEQUENCED = "app_id bigint, name string, seq int"


def test_only_games_with_reviews(games, reviews):
    catalogue = games((1, "a", []), (2, "b", []))
    written = reviews({(1, 1): 3, (9, 1): 5})
    for join in (op.game_review_counts, op.game_review_counts_by_union):
        assert rows(join(catalogue, written)) == [(1, "a", 3)]


def test_repeated_app_id(games, reviews):
    twice = games((5, "a", 1), (5, "b", 2), schema=SEQUENCED)
    written = reviews({(5, 1): 3})
    assert rows(op.game_review_counts(twice, written, seq="seq")) == [(5, "b", 3)]
    assert rows(op.game_review_counts_by_union(twice, written, seq="seq")) == [(5, "b", 3)]
    assert rows(op.game_review_counts(twice, written, names="concat")) == [(5, "a,b", 6)]


def test_the_largest_seq_wins_not_the_largest_name(games, reviews):
    twice = games((5, "z", 1), (5, "b", 2), (5, "c", 2), schema=SEQUENCED)
    written = reviews({(5, 1): 1})
    assert rows(op.game_review_counts(twice, written, seq="seq")) == [(5, "c", 1)]
    assert rows(op.game_review_counts_by_union(twice, written, seq="seq")) == [(5, "c", 1)]
    assert rows(op.game_review_counts(twice, written)) == [(5, "z", 1)]


def test_same_name_twice_multiplies_but_is_named_once(games, reviews):
    twice = games((5, "a", 1), (5, "a", 2), schema=SEQUENCED)
    assert rows(op.game_review_counts(twice, reviews({(5, 1): 2}), names="concat")) == [(5, "a", 4)]


def test_unknown_names_rule(games, reviews):
    with pytest.raises(ValueError):
        op.game_review_counts(games((1, "a", [])), reviews({(1, 1): 1}), names="other")


def test_a_hot_key_is_counted_before_the_shuffle(spark, games):
    """Half of all reviews are of one game; no shuffle carries single reviews."""
    written = spark.range(200_000).select(
        F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id") % 50).alias("app_id")
    )
    catalogue = games(*[(i, str(i), []) for i in range(50)])
    counts = op.game_review_counts(catalogue, written)
    assert sum(row.stat for row in counts.collect()) == 200_000
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan


def test_semi_and_anti(spark):
    frame = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "client_id bigint, v string")
    listed = spark.createDataFrame([(1,), (3,), (3,)], "client_id bigint")
    assert rows(op.only_listed(frame, listed, "client_id")) == [(1, "a"), (3, "c")]
    assert rows(op.without_listed(frame, listed)) == [(2, "b")]


@pytest.fixture
def world(games, reviews):
    catalogue = games(
        (1, "a", ["Indie"]), (2, "b", ["Indie", "Action"]), (3, "c", ["Action"]),
        (4, "d", ["Action"]), (5, "e", ["RPG"]),
    )
    written = reviews({
        (1, 1): 4, (1, -1): 9, (2, 1): 4, (2, -1): 2, (2, 0): 1, (3, -1): 6, (4, 0): 5,
        (5, -1): 50, (3, 1): 1,
    })
    return catalogue, written


def test_top_reviewed(world):
    answer = plans.top_reviewed(*world, n=5)
    assert [tuple(row) for row in answer.collect()] == [(1, "a", 4), (2, "b", 4)]


def test_over_threshold(world):
    assert rows(plans.over_threshold(*world, n=3)) == [(3, "c", 6), (4, "d", 5)]
    assert rows(plans.over_threshold(*world, n=2)) == [(2, "b", 3), (3, "c", 6), (4, "d", 5)]
    assert rows(plans.over_threshold(*world, n=2, negative="minus_one")) == [(3, "c", 6)]
    kept = plans.over_threshold(*world, n=2, in_language=F.col("app_id") != 3)
    assert rows(kept) == [(2, "b", 3), (4, "d", 5)]


def test_percentile_question(world):
    assert [tuple(r) for r in plans.percentile_question(*world, p=50).collect()] == [
        (4, "d", 5), (3, "c", 6)
    ]
    linear = plans.percentile_question(*world, p=90, method="linear")
    assert rows(linear) == [(3, "c", 6)]


def test_all_answers_equal_the_single_questions(spark, world, tmp_path):
    catalogue, written = world
    catalogue = catalogue.withColumns({
        "release_year": (F.col("app_id") + 2008).cast("int"),
        "avg_playtime": F.col("app_id") * 10,
        **{flag: F.col("app_id") > 2 for flag in ("linux", "mac", "windows")},
    })
    written = written.withColumn("lang", F.when(F.col("app_id") == 4, "es").otherwise("en"))
    english = F.col("lang") == "en"
    together = plans.all_answers(catalogue, written, english, more_than=2, p=50)
    single = {
        1: plans.platform_counts(catalogue),
        2: plans.top_playtime(catalogue),
        3: plans.top_reviewed(catalogue, written),
        4: plans.over_threshold(catalogue, written, n=2, in_language=english),
        5: plans.percentile_question(catalogue, written, p=50),
    }
    for number, answer in together.items():
        assert answer.collect() == single[number].collect(), number
        assert answer.columns == single[number].columns
    plans.write_answers(together, str(tmp_path))
    assert sorted(path.name for path in tmp_path.iterdir()) == ["1", "2", "3", "4", "5"]


def test_the_score_is_filtered_in_the_scan_and_texts_are_not_read(spark, games, tmp_path):
    rows = [(1, "text", 1), (1, "text", -1)]
    frame = spark.createDataFrame(rows, "app_id bigint, text string, score tinyint")
    frame.write.parquet(str(tmp_path / "reviews"))
    stored = spark.read.parquet(str(tmp_path / "reviews"))
    answer = plans.top_reviewed(games((1, "a", ["Indie"])), stored)
    plan = answer._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(score,1)" in plan
    assert "ReadSchema: struct<app_id:bigint,score:tinyint>" in plan


def test_platforms_and_playtime(spark):
    schema = ("app_id bigint, name string, release_year int, linux boolean, mac boolean, "
              "windows boolean, avg_playtime bigint, genres array<string>")
    catalogue = spark.createDataFrame([
        (1, "a", 2010, True, False, True, 5, ["Indie"]),
        (2, "b", 2019, False, False, True, 9, ["Indie"]),
        (3, "c", 2020, True, True, True, 99, ["Indie"]),
        (4, "d", 2015, True, False, False, 50, ["indie"]),
        (5, "e", 2011, False, False, False, 9, ["Indie"]),
    ], schema)
    assert rows(plans.platform_counts(catalogue)) == [(3, 1, 3)]
    top = plans.top_playtime(catalogue, n=2)
    assert [tuple(row) for row in top.collect()] == [(2, "b", 9), (5, "e", 9)]
    loose = plans.top_playtime(catalogue, n=1, match="substring")
    assert [tuple(row) for row in loose.collect()] == [(4, "d", 50)]


def test_answers_do_not_depend_on_partitioning(spark, world):
    catalogue, written = world
    spread = (catalogue.repartition(7), written.repartition(13))
    packed = (catalogue.coalesce(1), written.coalesce(1))
    for ask in (plans.top_reviewed, plans.over_threshold, plans.percentile_question):
        assert ask(*spread).collect() == ask(*packed).collect()


def jobs(spark):
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup())


@pytest.mark.parametrize("bits", [1 << 21, 64])
def test_prefilter_changes_no_answer(spark, games, reviews, bits):
    """A bitmap too small for the list lets more rows pass; the later join gives the same."""
    catalogue = games(*[(i, str(i), []) for i in range(5)])
    written = reviews({(i, -1): i + 1 for i in range(10)})
    before = jobs(spark)
    early = op.prefilter(written, catalogue, bits=bits)
    kept = op.for_listed(written, catalogue, F.col("score") < 0, F.col("app_id") > 1, bits=bits)
    assert jobs(spark) == before
    assert 15 <= early.count() <= (15 if bits > 64 else 55)
    assert jobs(spark) > before
    assert {r.app_id for r in early.collect()} >= set(range(5))
    assert kept.columns == written.columns
    assert rows(op.game_review_counts(catalogue, kept)) == [(2, "2", 3), (3, "3", 4), (4, "4", 5)]


def test_prefilter_of_keys_of_other_types_and_empty_lists(spark, games):
    texts = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "app_id int, text string")
    assert [r.app_id for r in op.prefilter(texts, games((2, "b", []))).collect()] == [2]
    assert op.prefilter(texts, games((2, "b", [])).limit(0)).count() == 0


def test_prefilter_by_tenant(spark):
    ids = spark.createDataFrame([(1, 5), (2, 6)], "client_id int, app_id bigint")
    all_rows = spark.createDataFrame([(1, 5), (1, 6), (2, 5), (2, 6)], "client_id int, app_id bigint")
    kept = op.prefilter(all_rows, ids, by=("client_id",))
    assert sorted(map(tuple, kept.collect())) == [(1, 5), (2, 6)]


def test_costly_condition_sees_only_listed_rows(spark, games):
    """It is checked once, in one condition behind the cheap one and the list."""
    texts = spark.createDataFrame(
        [(1, "x", 1), (2, "y", -1), (3, "y", -1), (4, None, 1)], "app_id bigint, text string, score int")
    costly = F.when(F.col("app_id") == 2, F.regexp_replace("text", "y", "z") == "z").otherwise(
        F.raise_error("looked at").cast("boolean"))
    kept = op.for_listed(texts, games((2, "b", [])), op.is_polarity("negative"), costly)
    assert rows(kept) == [(2, "y", -1)]
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1


def test_bucketed_tables_join_without_a_shuffle(spark, games, reviews):
    save_bucketed(games(*[(i, str(i), []) for i in range(20)]), "bucketed_games", "app_id", 4)
    save_bucketed(reviews({(i, 1): 2 for i in range(20)}), "bucketed_reviews", "app_id", 4)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        counts = op.game_review_counts(
            spark.table("bucketed_games"), spark.table("bucketed_reviews")
        )
        assert counts.count() == 20
        assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for table in ("bucketed_games", "bucketed_reviews"):
            spark.sql(f"DROP TABLE {table}")
