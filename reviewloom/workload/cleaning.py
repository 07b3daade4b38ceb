"""Cleaning of raw text rows, and round trips through CSV files.

The raw rows are the parts and line items written out as text, spoiled in a
different way for some sizes and quantities.
"""

from functools import reduce

from pyspark.sql import functions as F

from ..functions import marker_language
from ..operators import is_polarity, only_if, reduced_games
from ..schema import GAME_FIELDS
from ..session import shared_dir
from ..sources import (
    clean_games,
    clean_reviews,
    judge_games,
    judge_reviews,
    read_games,
    read_reviews,
    reason_counts,
    write_copy,
    write_judged,
    write_result,
)
from .questions import IS_ENGLISH_SQL, top_reviewed
from .registry import query
from .tables import ALL_REVIEWS_SQL, TEXT_REVIEWS_SQL, all_text_reviews, load, text_reviews

MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")

RAW_GAMES_SQL = f"""
raw_games AS (
  SELECT CASE p_size WHEN 7 THEN ' ' || p_partkey || ' ' WHEN 8 THEN p_partkey || '.0'
                     WHEN 9 THEN '+' || p_partkey ELSE CAST(p_partkey AS VARCHAR) END AS app_id,
         CASE p_size WHEN 10 THEN '' WHEN 11 THEN 'NA' ELSE p_name END AS name,
         CASE p_size WHEN 12 THEN 'May 2020' WHEN 13 THEN '2008-10-21' WHEN 14 THEN ''
                     WHEN 15 THEN 'Feb 30, 2010'
                     ELSE ({list(MONTHS)})[p_size % 12 + 1] || ' ' || (p_size % 28 + 1)
                          || ', ' || (1990 + p_size) END AS release_date,
         CASE WHEN p_size % 2 = 0 THEN 'True' ELSE 'False' END AS windows,
         CASE WHEN p_size % 3 = 0 THEN 'true' ELSE 'True' END AS mac,
         CASE WHEN p_size % 5 = 0 THEN 'True' END AS linux,
         CASE p_size WHEN 16 THEN '12.5' ELSE CAST(p_size AS VARCHAR) END AS avg_playtime,
         CASE p_size WHEN 17 THEN '' ELSE replace(p_name, ' ', ',') END AS genres,
         CASE p_size WHEN 18 THEN 36 ELSE 39 END AS n_fields
  FROM part),
judged_games AS (
  SELECT *,
    CASE WHEN n_fields < 37 THEN 'width'
         WHEN NOT regexp_full_match(app_id, '[+-]?[0-9]+') THEN 'bad app_id'
         WHEN coalesce(try_strptime(release_date, '%b %d, %Y'),
                       try_strptime(release_date, '%b %Y')) IS NULL THEN 'bad release date'
         WHEN NOT regexp_full_match(avg_playtime, '[+-]?[0-9]+') THEN 'bad playtime'
         WHEN name = '' THEN 'empty name'
         WHEN genres = '' THEN 'empty genres' END AS reason
  FROM raw_games)"""


def _raw_games(spark, sf_dir):
    size = F.col("p_size")
    key = F.col("p_partkey").cast("string")
    month = F.element_at(F.array(*map(F.lit, MONTHS)), size % 12 + 1)
    day = (size % 28 + 1).cast("string")
    year = (size + 1990).cast("string")
    return load(spark, sf_dir, "part").select(
        F.when(size == 7, F.concat(F.lit(" "), key, F.lit(" ")))
        .when(size == 8, F.concat(key, F.lit(".0")))
        .when(size == 9, F.concat(F.lit("+"), key))
        .otherwise(key).alias("app_id"),
        F.when(size == 10, "").when(size == 11, "NA").otherwise(F.col("p_name")).alias("name"),
        F.when(size == 12, "May 2020")
        .when(size == 13, "2008-10-21")
        .when(size == 14, "")
        .when(size == 15, "Feb 30, 2010")
        .otherwise(F.concat(month, F.lit(" "), day, F.lit(", "), year)).alias("release_date"),
        F.when(size % 2 == 0, "True").otherwise("False").alias("windows"),
        F.when(size % 3 == 0, "true").otherwise("True").alias("mac"),
        F.when(size % 5 == 0, "True").alias("linux"),
        F.when(size == 16, "12.5").otherwise(size.cast("string")).alias("avg_playtime"),
        F.when(size == 17, "")
        .otherwise(F.replace("p_name", F.lit(" "), F.lit(","))).alias("genres"),
        F.when(size == 18, 36).otherwise(39).alias("n_fields"),
    )


RAW_REVIEWS_SQL = """
raw_reviews AS (
  SELECT CASE CAST(l_quantity AS INTEGER) WHEN 3 THEN l_partkey || ' ' WHEN 4 THEN NULL
              ELSE CAST(l_partkey AS VARCHAR) END AS app_id,
         CASE CAST(l_quantity AS INTEGER) WHEN 5 THEN ''
              ELSE l_linestatus || l_quantity END AS text,
         CASE CAST(l_quantity AS INTEGER) WHEN 6 THEN '257' WHEN 7 THEN '' ELSE
           CASE l_returnflag WHEN 'R' THEN '1' WHEN 'A' THEN '-1' ELSE '0' END END AS score,
         CASE CAST(l_quantity AS INTEGER) WHEN 8 THEN 3 ELSE 4 END AS n_fields
  FROM lineitem),
judged_reviews AS (
  SELECT *,
    CASE WHEN n_fields < 4 THEN 'width'
         WHEN NOT coalesce(regexp_full_match(app_id, '[+-]?[0-9]+'), false) THEN 'bad app_id'
         WHEN TRY_CAST(score AS TINYINT) IS NULL THEN 'bad score'
         WHEN text = '' THEN 'empty text' END AS reason
  FROM raw_reviews)"""


def _raw_reviews(spark, sf_dir):
    quantity = F.col("l_quantity").cast("int")
    key = F.col("l_partkey").cast("string")
    flag = F.col("l_returnflag")
    return load(spark, sf_dir, "lineitem").select(
        F.when(quantity == 3, F.concat(key, F.lit(" ")))
        .when(quantity != 4, key).alias("app_id"),
        F.when(quantity == 5, "")
        .otherwise(F.concat("l_linestatus", F.col("l_quantity").cast("string"))).alias("text"),
        F.when(quantity == 6, "257").when(quantity == 7, "")
        .when(flag == "R", "1").when(flag == "A", "-1").otherwise("0").alias("score"),
        F.when(quantity == 8, 3).otherwise(4).alias("n_fields"),
    )


@query("clean_games", f"""
WITH {RAW_GAMES_SQL}
SELECT CAST(app_id AS BIGINT) AS app_id, name,
       CAST(year(coalesce(try_strptime(release_date, '%b %d, %Y'),
                          try_strptime(release_date, '%b %Y'))) AS INTEGER) AS release_year,
       windows = 'True' AS windows, mac = 'True' AS mac, coalesce(linux = 'True', false) AS linux,
       CAST(avg_playtime AS BIGINT) AS avg_playtime, genres
FROM judged_games WHERE reason IS NULL""")
def cleaned_games(spark, sf_dir):
    clean, _ = clean_games(_raw_games(spark, sf_dir))
    return clean.withColumn("genres", F.array_join("genres", ","))


@query("clean_reviews", f"""
WITH {RAW_REVIEWS_SQL}
SELECT CAST(app_id AS BIGINT) AS app_id, text, CAST(score AS TINYINT) AS score
FROM judged_reviews WHERE reason IS NULL""")
def cleaned_reviews(spark, sf_dir):
    clean, _ = clean_reviews(_raw_reviews(spark, sf_dir))
    return clean


@query("quarantine", f"""
WITH {RAW_GAMES_SQL}
SELECT reason, app_id, name, release_date, avg_playtime, genres
FROM judged_games WHERE reason IS NOT NULL""")
def quarantine(spark, sf_dir):
    _, rejected = clean_games(_raw_games(spark, sf_dir))
    return rejected.select("reason", "app_id", "name", "release_date", "avg_playtime", "genres")


REASONS_SQL = f"""
WITH {RAW_GAMES_SQL}, {RAW_REVIEWS_SQL}
SELECT 'games' AS input, coalesce(reason, 'accepted') AS reason, count(*) AS n
FROM judged_games GROUP BY ALL
UNION ALL
SELECT 'reviews', coalesce(reason, 'accepted'), count(*) FROM judged_reviews GROUP BY ALL"""


@query("reject_reasons", REASONS_SQL)
def reject_reasons(spark, sf_dir):
    counted = [
        reason_counts(judged).withColumn("input", F.lit(name))
        for name, judged in (
            ("games", judge_games(_raw_games(spark, sf_dir))),
            ("reviews", judge_reviews(_raw_reviews(spark, sf_dir))),
        )
    ]
    return reduce(lambda left, right: left.unionByName(right), counted)


@query("reject_reasons_observed", REASONS_SQL)
def reject_reasons_observed(spark, sf_dir):
    """The same, counted by the jobs that write the clean rows and the quarantine."""
    folder = shared_dir(spark, "judged")
    counted = []
    for name, judged in (
        ("games", judge_games(_raw_games(spark, sf_dir))),
        ("reviews", judge_reviews(_raw_reviews(spark, sf_dir))),
    ):
        _, _, counts = write_judged(judged, f"{folder}/{name}")
        counted.append(counts.withColumn("input", F.lit(name)))
    return reduce(lambda left, right: left.unionByName(right), counted)


@query("csv_games", """
SELECT p_partkey AS app_id, p_name || ', "' || p_brand || '"' || chr(10) || p_type AS name,
       CAST(1990 + p_size AS INTEGER) AS release_year, p_size % 2 = 0 AS windows,
       CAST(p_size AS BIGINT) AS avg_playtime, replace(p_name, ' ', ',') AS genres
FROM part""")
def csv_games(spark, sf_dir):
    """Parts as a 39-column file with quotes, commas and line breaks, read back."""
    part = load(spark, sf_dir, "part")
    values = {
        "app_id": F.col("p_partkey"),
        "name": F.concat(
            "p_name", F.lit(', "'), "p_brand", F.lit('"\n'), "p_type"
        ),
        "release_date": F.concat(F.lit("Oct 5, "), (F.col("p_size") + 1990).cast("string")),
        "windows": F.when(F.col("p_size") % 2 == 0, "True").otherwise("False"),
        "mac": F.lit("False"),
        "linux": F.lit("False"),
        "avg_playtime": F.col("p_size"),
        "genres": F.replace("p_name", F.lit(" "), F.lit(",")),
    }
    columns = [F.lit("x").alias(f"c{i}") for i in range(39)]
    for name, position in GAME_FIELDS.items():
        columns[position] = values[name].alias(name)
    path = shared_dir(spark, "games-csv")
    write_copy(part.select(*columns), path)
    clean, _ = clean_games(read_games(spark, path))
    return clean.select(
        "app_id", "name", "release_year", "windows", "avg_playtime",
        F.array_join("genres", ",").alias("genres"),
    )


@query("csv_reviews", f"""
WITH {ALL_REVIEWS_SQL}
SELECT doc_id AS app_id, md5(text) AS digest, length(text) AS n_chars,
       CAST(score AS TINYINT) AS score
FROM all_reviews""")
def csv_reviews(spark, sf_dir):
    """All documents as a review file, whole texts, read back."""
    path = shared_dir(spark, "reviews-csv")
    raw = all_text_reviews(spark, sf_dir).select("doc_id", "lang", "text", "score")
    write_copy(raw, path)
    clean, _ = clean_reviews(read_reviews(spark, path))
    return clean.select(
        "app_id",
        F.md5("text").alias("digest"),
        F.length("text").cast("bigint").alias("n_chars"),
        "score",
    )


@query("csv_review_blocks", f"""
WITH {ALL_REVIEWS_SQL}
SELECT doc_id AS app_id, md5(text) AS digest, length(text) AS n_chars,
       CAST(score AS TINYINT) AS score
FROM all_reviews""")
def csv_review_blocks(spark, sf_dir):
    """The same file, cut into several blocks whose records are put together."""
    path = shared_dir(spark, "reviews-csv")
    raw = all_text_reviews(spark, sf_dir).select("doc_id", "lang", "text", "score")
    write_copy(raw, path)
    usual = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")  # the lines are cut and stored right here
    try:
        read = read_reviews(spark, path, layout="blocks")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", usual)
    clean, _ = clean_reviews(read)
    return clean.select(
        "app_id",
        F.md5("text").alias("digest"),
        F.length("text").cast("bigint").alias("n_chars"),
        "score",
    )


@query("english_negative_copy", f"""
WITH {TEXT_REVIEWS_SQL}
SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, CAST(score AS VARCHAR) AS score, md5(text) AS digest
FROM reviews WHERE score = -1 AND {IS_ENGLISH_SQL}""")
def english_negative_copy(spark, sf_dir):
    """Whole original rows of the English reviews with score -1, as a CSV copy."""
    rows = text_reviews(spark, sf_dir)
    negative = is_polarity("negative", "minus_one")
    chosen = rows.filter(negative).filter(only_if(negative, marker_language("text") == "en"))
    path = shared_dir(spark, "english-negative")
    write_copy(chosen.select("doc_id", "lang", "text", "score"), path)
    copy = spark.read.options(header=True, multiLine=True, quote='"', escape='"').schema(
        "doc_id string, lang string, text string, score string"
    ).csv(path)
    return copy.select("doc_id", "lang", "score", F.md5("text").alias("digest"))


def _text_back(spark, path):
    """A copy as it was written, all columns as text."""
    return spark.read.options(header=True, multiLine=True, quote='"', escape='"').csv(path)


@query("raw_copy", f"""
WITH {ALL_REVIEWS_SQL}
SELECT CAST(doc_id AS VARCHAR) AS app_id, lang, CAST(score AS VARCHAR) AS review_score, source,
       md5(text) AS digest
FROM all_reviews JOIN documents USING (doc_id, lang, text)
WHERE score = -1 AND {IS_ENGLISH_SQL}""")
def raw_copy(spark, sf_dir):
    """Whole records of a review file, columns no question reads included, copied from CSV to CSV."""
    path, copy = shared_dir(spark, "reviews-csv"), shared_dir(spark, "english-negative")
    more = load(spark, sf_dir, "documents").select("doc_id", "source")
    rows = all_text_reviews(spark, sf_dir).select("doc_id", "lang", "text", "score").join(more, "doc_id")
    write_copy(rows.select(F.col("doc_id").alias("app_id"), "lang", F.col("text").alias("review_text"),
                           F.col("score").alias("review_score"), "source"), path)
    read = read_reviews(spark, path, original=True)
    negative = is_polarity("negative", "minus_one")
    chosen = read.filter(negative).filter(only_if(negative, marker_language("text") == "en"))
    write_copy(chosen.select("original.*"), copy)
    return _text_back(spark, copy).select(
        "app_id", "lang", "review_score", "source", F.md5("review_text").alias("digest"))


@query("reduced_files", """
SELECT CAST(p_partkey AS VARCHAR) AS app_id, p_name || ', "' || p_brand || '"' || chr(10) || p_type AS name,
       CAST(p_size AS VARCHAR) AS size, p_brand AS brand
FROM part ORDER BY p_partkey DESC LIMIT 50""")
def reduced_files(spark, sf_dir):
    """The first 50 records of a catalogue in file order, whole, as a file; it is written by falling key."""
    path, copy = shared_dir(spark, "games-csv"), shared_dir(spark, "games-reduced")
    columns = [F.lit("x").alias(f"c{i}") for i in range(39)]
    columns[0] = F.col("p_partkey").alias("app_id")
    columns[1] = F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"\n'), "p_type").alias("name")
    columns[3] = F.col("p_size").alias("size")
    columns[38] = F.col("p_brand").alias("brand")
    falling = load(spark, sf_dir, "part").repartitionByRange(4, F.desc("p_partkey"))
    write_copy(falling.sortWithinPartitions(F.desc("p_partkey")).select(*columns), path)
    first = reduced_games(read_games(spark, path, original=True, place=True), 50, "place")
    write_copy(first.select("original.*"), copy)
    return _text_back(spark, copy).select("app_id", "name", "size", "brand")


@query("result_files", """
WITH counts AS (
  SELECT p_partkey, p_name, count(*) AS n FROM part JOIN lineitem ON l_partkey = p_partkey
  WHERE list_contains(string_split(p_name, ' '), 'small') AND l_returnflag = 'R'
  GROUP BY p_partkey, p_name ORDER BY n DESC, p_partkey LIMIT 5)
SELECT CAST(p_partkey AS VARCHAR) AS "AppID", p_name AS "Name", CAST(n AS VARCHAR) AS "Reviews"
FROM counts""")
def result_files(spark, sf_dir):
    """The answer to question 3 as a CSV result file, read back as text."""
    path = shared_dir(spark, "results")
    write_result(top_reviewed(spark, sf_dir), path, 3)
    return spark.read.option("header", True).csv(f"{path}/3")
