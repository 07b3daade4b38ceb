import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from reviewloom import operators as op
from reviewloom.functions import char_ngrams, marker_language
from reviewloom.functions.text import counted

DOCS = "/root/testdata/sf0.01/documents.parquet"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(DOCS).filter(F.col("lang").isin("en", "es"))


def accuracy(predicted):
    return predicted.agg(F.avg((F.col("lang") == F.col("predicted")).cast("int"))).first()[0]


def test_ngrams_are_code_points(spark):
    frame = spark.createDataFrame([("aÉ😀b😀c\nd",), ("ab",), ("",), (None,)], "t string")
    got = [row.g for row in frame.select(char_ngrams("t", 3).alias("g")).collect()]
    assert got == [["aé😀", "é😀b", "😀b😀", "b😀c", "😀c\n", "c\nd"], [], [], None]


def test_markers(spark):
    frame = spark.createDataFrame(
        [("The cat AND the dog", "en"), ("el perro de la casa", "es"), ("xyz", "unknown"),
         ("", "unknown"), (None, "unknown"), ("the, and.", "unknown"), ("the la", "en"),
         ("the\tel\nla", "es"), ("thethe the", "en")], "t string, want string")
    for row in frame.withColumn("got", marker_language("t")).collect():
        assert row.got == row.want, row.t


def test_marker_accuracy(documents):
    predicted = documents.select("lang", marker_language("text").alias("predicted"))
    counts = {(r.lang, r.predicted): r.n for r in op.confusion(predicted).collect()}
    known = sum(n for (_, label), n in counts.items() if label != "unknown")
    right = sum(n for (lang, label), n in counts.items() if lang == label)
    assert right / known > 0.99


def test_profile_accuracy_on_unseen_documents(documents):
    train = documents.filter("doc_id % 5 <> 0")
    test = documents.filter("doc_id % 5 = 0")
    profiles = op.fit_profiles(op.gram_counts(train))
    assert accuracy(op.classify(test, profiles, keys=("doc_id", "lang"))) > 0.98


def test_profile_weights(spark):
    docs = spark.createDataFrame([("abcd", "en"), ("abcabc", "es"), ("zzzz", "fr")],
                                 "text string, lang string")
    grams = {"en": Counter(["abc", "bcd"]), "es": Counter(["abc", "bca", "cab", "abc"])}
    vocabulary = set().union(*grams.values())
    got = {r.gram: (r.en, r.es) for r in op.fit_profiles(op.gram_counts(docs)).collect()}
    assert got.keys() == vocabulary
    for gram in vocabulary:
        for weight, lang in zip(got[gram], ("en", "es")):
            total = sum(grams[lang].values()) + len(vocabulary)
            assert weight == pytest.approx(math.log((grams[lang][gram] + 1) / total))


def test_without_a_known_gram(spark):
    docs = spark.createDataFrame([("abcd", "en"), ("xyz", "es")], "text string, lang string")
    profiles = op.fit_profiles(op.gram_counts(docs))
    asked = spark.createDataFrame([(1, "qqqq"), (2, "ab"), (3, None), (4, "ABC")],
                                  "doc_id bigint, text string")
    got = {r.doc_id: r.predicted for r in op.classify(asked, profiles).collect()}
    assert got == {1: "unknown", 2: "unknown", 3: "unknown", 4: "en"}


def test_ties_go_to_the_first_name(spark):
    docs = spark.createDataFrame([("abc", "es"), ("abc", "en")], "text string, lang string")
    profiles = op.fit_profiles(op.gram_counts(docs))
    asked = spark.createDataFrame([(1, "abc")], "doc_id bigint, text string")
    assert op.classify(asked, profiles).first().predicted == "en"


@pytest.mark.parametrize("count_first", [False, True])
def test_a_large_profile_is_not_broadcast(spark, documents, tmp_path, count_first):
    """Bytes decide; beyond the limit the join is by sort-merge, with the same answer."""
    op.fit_profiles(op.gram_counts(documents)).write.parquet(str(tmp_path / "profiles"))
    profiles = spark.read.parquet(str(tmp_path / "profiles"))
    small = op.classify(documents, profiles, count_first=count_first)
    assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()
    want = sorted(map(tuple, small.collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        large = op.classify(documents, profiles, count_first=count_first)
        plan = large._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
        assert sorted(map(tuple, large.collect())) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_classification_runs_nothing_before_the_action(spark, documents):
    profiles = op.fit_profiles(op.gram_counts(documents))
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup())
    op.classify(documents, profiles)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup()) == before


def test_counted(spark):
    df = spark.createDataFrame([(1, ["b", "a", "b", "b"]), (2, []), (3, None), (4, ["x"])], "id int, xs array<string>")
    got = {r.id: None if r.c is None else [tuple(c) for c in r.c] for r in df.select("id", counted("xs").alias("c")).collect()}
    assert got == {1: [("a", 1), ("b", 3)], 2: None, 3: None, 4: [("x", 1)]}
