import pytest
from pyspark.sql import functions as F

from reviewloom.functions import field_count, release_year, strict_long, strict_tinyint, true_flag
from reviewloom.schema import GAMES, REVIEWS
from reviewloom.sources import (
    clean_games,
    clean_reviews,
    judge_games,
    judge_reviews,
    reason_counts,
    write_judged,
)


def values(spark, texts, parse):
    frame = spark.createDataFrame([(i, text) for i, text in enumerate(texts)], "i int, t string")
    return [row.v for row in frame.select("i", parse("t").alias("v")).orderBy("i").collect()]


def test_integers(spark):
    texts = ["7", "+7", "-7", " 7 ", "7 ", "7\n", "7.0", "", None, "1e3", "9223372036854775807",
             "9223372036854775808", "0x1", "1_000", "٣"]
    assert values(spark, texts, strict_long) == [
        7, 7, -7, None, None, None, None, None, None, None, 9223372036854775807,
        None, None, None, None,
    ]


def test_scores_do_not_wrap(spark):
    assert values(spark, ["1", "-1", "257", "127", "-129"], strict_tinyint) == [
        1, -1, None, 127, None
    ]


@pytest.mark.parametrize("text, year", [
    ("Oct 21, 2008", 2008), ("Oct 05, 2008", 2008), ("Oct 5, 2008", 2008), ("oct 5, 2008", 2008),
    ("OCT 5, 2008", 2008), ("Oct  5,  2008", 2008), ("May 2020", 2020), ("May  2020", 2020),
    ("2008-10-21", None), ("", None), (None, None), ("Feb 30, 2010", None), ("Feb 29, 2011", None),
    ("Feb 29, 2012", 2012), ("October 21, 2008", None), ("Oct 21,2008", None),
    ("Oct 21, 08", None), ("Oct 21, 2008 ", None), (" Oct 21, 2008", None), ("Oct 0, 2008", None),
    ("Oct 32, 2008", None), ("Xyz 3, 2008", None), ("Oct 21 2008", None),
])
def test_dates(spark, text, year):
    assert values(spark, [text], release_year) == [year]


def test_flags(spark):
    assert values(spark, ["True", "true", "False", "", None, "1"], true_flag) == [
        True, False, False, False, False, False
    ]


def test_field_count(spark):
    texts = ["a,b,c", 'a,"b,b",c', 'a,"b ""x,y"" b"', "", ",,"]
    assert values(spark, texts, field_count) == [3, 3, 2, 1, 3]


GOOD = ("7", "A", "Oct 5, 2008", "True", "False", "False", "3", "Indie,RPG", 39)
FIELDS = ["app_id", "name", "release_date", "windows", "mac", "linux", "avg_playtime", "genres",
          "n_fields"]


def raw_games(spark, *changes):
    rows = []
    for change in changes:
        rows.append(tuple(change.get(name, value) for name, value in zip(FIELDS, GOOD)))
    schema = ", ".join(f"{name} string" for name in FIELDS[:-1]) + ", n_fields int"
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("change, reason", [
    ({}, None),
    ({"name": "NA"}, None),
    ({"genres": "null"}, None),
    ({"name": ""}, "empty name"),
    ({"name": None}, "empty name"),
    ({"genres": ""}, "empty genres"),
    ({"n_fields": 36}, "width"),
    ({"n_fields": 37}, None),
    ({"app_id": " 7 "}, "bad app_id"),
    ({"release_date": ""}, "bad release date"),
    ({"avg_playtime": "7.0"}, "bad playtime"),
    ({"avg_playtime": None}, "bad playtime"),
    ({"name": "", "avg_playtime": ""}, "bad playtime"),
])
def test_game_reasons(spark, change, reason):
    assert judge_games(raw_games(spark, change)).first().reason == reason


def test_clean_games(spark):
    raw = raw_games(spark, {}, {"genres": "RPG, Indie"}, {"name": ""})
    clean, quarantine = clean_games(raw)
    assert [(f.name, f.dataType) for f in clean.schema] == [(f.name, f.dataType) for f in GAMES]
    assert sorted(map(tuple, clean.collect())) == [
        (7, "A", 2008, True, False, False, 3, ["Indie", "RPG"]),
        (7, "A", 2008, True, False, False, 3, ["RPG", " Indie"]),
    ]
    assert [row.reason for row in quarantine.collect()] == ["empty name"]
    counts = {row.reason: row.n for row in reason_counts(judge_games(raw)).collect()}
    assert counts == {"accepted": 2, "empty name": 1}


def test_clean_reviews(spark):
    rows = [("5", "good", "1", 4), ("5", "bad", "257", 4), ("5", "", "1", 4), ("5", None, "1", 4),
            ("5", "NA", "-1", 4), ("x", "t", "1", 4), ("5", "t", "1", 3), ("5", "t", "", 4)]
    raw = spark.createDataFrame(rows, "app_id string, text string, score string, n_fields int")
    clean, quarantine = clean_reviews(raw)
    assert [(f.name, f.dataType) for f in clean.schema] == [(f.name, f.dataType) for f in REVIEWS]
    assert sorted(map(tuple, clean.collect())) == [(5, "NA", -1), (5, "good", 1)]
    reasons = quarantine.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).collect()
    assert {row.reason: row.n for row in reasons} == {
        "bad score": 2, "empty text": 2, "bad app_id": 1, "width": 1
    }


def test_written_and_counted_in_one_job(spark, tmp_path):
    raw = raw_games(spark, {}, {"genres": "RPG, Indie"}, {"name": ""}, {"app_id": "x"}).repartition(3)
    judged = judge_games(raw)
    clean, quarantine, counts = write_judged(judged, str(tmp_path / "judged"))
    wanted, rejected = clean_games(raw)
    assert clean.dtypes == wanted.dtypes
    assert sorted(map(tuple, clean.collect())) == sorted(map(tuple, wanted.collect()))
    assert quarantine.columns == rejected.columns
    assert sorted(map(str, quarantine.collect())) == sorted(map(str, rejected.collect()))
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, reason_counts(judged).collect()))


def test_written_from_an_empty_table(spark, tmp_path):
    raw = spark.createDataFrame([], "app_id string, text string, score string, n_fields int")
    clean, quarantine, counts = write_judged(judge_reviews(raw), str(tmp_path / "judged"))
    assert (clean.count(), quarantine.count(), counts.count()) == (0, 0, 0)
