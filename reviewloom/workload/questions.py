"""The five questions, and the steps only they use."""

from pyspark.sql import functions as F

from .. import operators as op
from .. import plans
from ..functions import marker_language
from ..sources import as_result
from .registry import query
from .tables import (
    GAMES_SQL,
    ORDER_GAMES_SQL,
    REVIEWS_SQL,
    TEXT_GAMES_SQL,
    TEXT_REVIEWS_SQL,
    games,
    order_games,
    reviews,
    text_games,
    text_reviews,
)

STAT_HEADER = 'app_id AS "AppID", name AS "Name", stat AS "Reviews"'


@query("platform_counts", f"""
WITH {GAMES_SQL}
SELECT CAST(sum(CASE WHEN linux THEN 1 ELSE 0 END) AS BIGINT) AS "Linux",
       CAST(sum(CASE WHEN mac THEN 1 ELSE 0 END) AS BIGINT) AS "Mac",
       CAST(sum(CASE WHEN windows THEN 1 ELSE 0 END) AS BIGINT) AS "Windows"
FROM games""")
def platform_counts(spark, sf_dir):
    return as_result(plans.platform_counts(games(spark, sf_dir)), 1)


@query("top_playtime", f"""
WITH {ORDER_GAMES_SQL}
SELECT app_id AS "AppID", name AS "Name", avg_playtime AS "Average playtime forever"
FROM games
WHERE list_contains(genres, '1-URGENT') AND contains(CAST(release_year AS VARCHAR), '199')
ORDER BY avg_playtime DESC, app_id LIMIT 10""")
def top_playtime(spark, sf_dir):
    answer = plans.top_playtime(order_games(spark, sf_dir), "1-URGENT", 1990, 10)
    return as_result(answer, 2)


@query("top_playtime_text", f"""
WITH {ORDER_GAMES_SQL}
SELECT app_id AS "AppID", name AS "Name", avg_playtime AS "Average playtime forever"
FROM games
WHERE contains(lower(array_to_string(genres, ',')), 'urgent') AND contains(release_date, '199')
ORDER BY avg_playtime DESC, app_id LIMIT 10""")
def top_playtime_text(spark, sf_dir):
    answer = plans.top_playtime(
        order_games(spark, sf_dir), "Urgent", 1990, 10, match="substring", date_text="release_date"
    )
    return as_result(answer, 2)


@query("top_reviewed", f"""
WITH {GAMES_SQL}, {REVIEWS_SQL}
SELECT app_id AS "AppID", name AS "Name", count(*) AS "Reviews"
FROM games JOIN reviews USING (app_id)
WHERE list_contains(genres, 'small') AND score = 1
GROUP BY app_id, name ORDER BY count(*) DESC, app_id LIMIT 5""")
def top_reviewed(spark, sf_dir):
    return as_result(plans.top_reviewed(games(spark, sf_dir), reviews(spark, sf_dir), "small"), 3)


@query("over_threshold", f"""
WITH {GAMES_SQL}, {REVIEWS_SQL}
SELECT app_id AS "AppID", name AS "Name", count(*) AS "Reviews"
FROM games JOIN reviews USING (app_id)
WHERE list_contains(genres, 'large') AND score <> 1
GROUP BY app_id, name HAVING count(*) > 25""")
def over_threshold(spark, sf_dir):
    answer = plans.over_threshold(games(spark, sf_dir), reviews(spark, sf_dir), "large", 25)
    return as_result(answer, 4)


@query("over_threshold_minus_one", f"""
WITH {GAMES_SQL}, {REVIEWS_SQL}
SELECT app_id AS "AppID", name AS "Name", count(*) AS "Reviews"
FROM games JOIN reviews USING (app_id)
WHERE contains(lower(array_to_string(genres, ',')), 'larg') AND score = -1
GROUP BY app_id, name HAVING count(*) > 12""")
def over_threshold_minus_one(spark, sf_dir):
    answer = plans.over_threshold(
        games(spark, sf_dir), reviews(spark, sf_dir), "Larg", 12,
        match="substring", negative="minus_one",
    )
    return as_result(answer, 4)


TEXT_COUNTS_SQL = """
SELECT app_id AS "AppID", name AS "Name", count(*) AS "Reviews"
FROM games JOIN reviews USING (app_id)
WHERE list_contains(genres, 'es') AND score <> 1 AND {condition}
GROUP BY app_id, name HAVING count(*) > 2"""


@query("over_threshold_language", f"""
WITH {TEXT_GAMES_SQL}, {TEXT_REVIEWS_SQL}
{TEXT_COUNTS_SQL.format(condition="lang = 'en'")}""")
def over_threshold_language(spark, sf_dir):
    answer = plans.over_threshold(
        text_games(spark, sf_dir), text_reviews(spark, sf_dir), "es", 2, F.col("lang") == "en"
    )
    return as_result(answer, 4)


def marker_sql(words):
    listed = ", ".join(f"'{word}'" for word in words)
    return (
        r"len(list_filter(string_split_regex(lower(text), '\s+'), "
        f"lambda w: w IN ({listed})))"
    )


def predicted_sql():
    from ..functions import MARKER_WORDS

    hits_en, hits_es = marker_sql(MARKER_WORDS["en"]), marker_sql(MARKER_WORDS["es"])
    return (
        f"CASE WHEN {hits_en} + {hits_es} = 0 THEN 'unknown' "
        f"WHEN {hits_en} >= {hits_es} THEN 'en' ELSE 'es' END"
    )


IS_ENGLISH_SQL = f"{predicted_sql()} = 'en'"


@query("over_threshold_marker", f"""
WITH {TEXT_GAMES_SQL}, {TEXT_REVIEWS_SQL}
{TEXT_COUNTS_SQL.format(condition=IS_ENGLISH_SQL)}""")
def over_threshold_marker(spark, sf_dir):
    answer = plans.over_threshold(
        text_games(spark, sf_dir), text_reviews(spark, sf_dir), "es", 2,
        marker_language("text") == "en",
    )
    return as_result(answer, 4)


LARGE_COUNTS_SQL = f"""
WITH {GAMES_SQL}, {REVIEWS_SQL}, stats AS (
  SELECT app_id, name, count(*) AS stat
  FROM games JOIN reviews USING (app_id)
  WHERE list_contains(genres, 'large') AND score <> 1
  GROUP BY app_id, name)"""

CUT_SQL = f"""{LARGE_COUNTS_SQL}, placed AS (
  SELECT *, row_number() OVER (ORDER BY stat, app_id DESC) AS place, count(*) OVER () AS n
  FROM stats)
SELECT {STAT_HEADER} FROM placed
WHERE place > greatest(0, CAST(ceil(CAST(90 AS DOUBLE) / 100 * n) AS BIGINT) - 1)"""


@query("percentile_cut", CUT_SQL)
def percentile_cut(spark, sf_dir):
    answer = plans.percentile_question(games(spark, sf_dir), reviews(spark, sf_dir), "large")
    return as_result(answer, 5)


@query("percentile_keep", f"""{LARGE_COUNTS_SQL}, placed AS (
  SELECT *, row_number() OVER (ORDER BY stat) AS place, count(*) OVER () AS n FROM stats)
SELECT {STAT_HEADER} FROM stats WHERE stat >= (
  SELECT min(stat) FROM placed
  WHERE place > greatest(0, CAST(ceil(CAST(90 AS DOUBLE) / 100 * n) AS BIGINT) - 1))""")
def percentile_keep(spark, sf_dir):
    answer = plans.percentile_question(
        games(spark, sf_dir), reviews(spark, sf_dir), "large", ties="keep"
    )
    return as_result(answer, 5)


@query("percentile_linear", f"""{LARGE_COUNTS_SQL}
SELECT {STAT_HEADER} FROM stats
WHERE stat >= (SELECT quantile_cont(CAST(stat AS DOUBLE), 0.9) FROM stats)""")
def percentile_linear(spark, sf_dir):
    answer = plans.percentile_question(
        games(spark, sf_dir), reviews(spark, sf_dir), "large", method="linear"
    )
    return as_result(answer, 5)


@query("top_n_by_group", f"""
WITH {GAMES_SQL}, {REVIEWS_SQL}, stats AS (
  SELECT app_id, name, count(*) AS stat FROM games JOIN reviews USING (app_id)
  GROUP BY app_id, name)
SELECT app_id, name, stat FROM stats
QUALIFY row_number() OVER (PARTITION BY name ORDER BY stat DESC, app_id) <= 3""")
def top_n_by_group(spark, sf_dir):
    stats = op.game_review_counts(games(spark, sf_dir), reviews(spark, sf_dir))
    return op.top_n(stats, 3, by=("name",))


TOGETHER_SQL = f"""
WITH {GAMES_SQL},
reviews AS (
  SELECT l_partkey AS app_id, l_linestatus AS text,
         CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN -1 ELSE 0 END AS score
  FROM lineitem),
dated AS (
  SELECT *, 1990 + avg_playtime AS release_year FROM games),
rated AS (
  SELECT app_id, name, genres, count(*) FILTER (score = 1) AS positive,
         count(*) FILTER (score <> 1) AS negative,
         count(*) FILTER (score <> 1 AND text = 'F') AS in_language
  FROM games JOIN reviews USING (app_id) GROUP BY app_id, name, genres),
best AS (
  SELECT app_id, name, positive AS stat FROM rated
  WHERE list_contains(genres, 'small') AND positive > 0 ORDER BY stat DESC, app_id LIMIT 5),
longest AS (
  SELECT app_id, name, avg_playtime AS stat FROM dated
  WHERE list_contains(genres, 'small') AND contains(CAST(release_year AS VARCHAR), '201')
  ORDER BY stat DESC, app_id LIMIT 10),
placed AS (
  SELECT app_id, name, negative AS stat, count(*) OVER () AS n,
         row_number() OVER (ORDER BY negative, app_id DESC) AS place
  FROM rated WHERE list_contains(genres, 'large') AND negative > 0)
SELECT 1 AS question, NULL::BIGINT AS app_id, 'Linux' AS name, count(*) FILTER (linux) AS stat
FROM games
UNION ALL SELECT 1, NULL, 'Mac', count(*) FILTER (mac) FROM games
UNION ALL SELECT 1, NULL, 'Windows', count(*) FILTER (windows) FROM games
UNION ALL SELECT 2, app_id, name, stat FROM longest
UNION ALL SELECT 3, app_id, name, stat FROM best
UNION ALL SELECT 4, app_id, name, in_language FROM rated
  WHERE list_contains(genres, 'large') AND in_language > 12
UNION ALL SELECT 5, app_id, name, stat FROM placed
  WHERE place > greatest(0, CAST(ceil(CAST(90 AS DOUBLE) / 100 * n) AS BIGINT) - 1)"""


@query("all_answers", TOGETHER_SQL)
def all_answers(spark, sf_dir):
    """The five answers in one table; the line status stands for the language."""
    catalogue = games(spark, sf_dir).withColumn(
        "release_year", (F.col("avg_playtime") + 1990).cast("int")
    )
    rated = reviews(spark, sf_dir, text="l_linestatus")
    answers = plans.all_answers(
        catalogue, rated, F.col("text") == "F", "small", "large", more_than=12
    )
    platforms = answers.pop(1)
    pairs = [F.struct(F.lit(name).alias("name"), F.col(name).alias("stat"))
             for name in platforms.columns]
    table = platforms.select(F.inline(F.array(*pairs))).select(
        F.lit(1).alias("question"), F.lit(None).cast("bigint").alias("app_id"), "name", "stat"
    )
    for number, answer in answers.items():
        table = table.unionByName(answer.withColumn("question", F.lit(number)))
    return table
