"""Keyed joins and aggregations on their own."""

from pyspark.sql import functions as F

from .. import operators as op
from .registry import query
from .tables import GAMES_SQL, REVIEWS_SQL, games, load, reviews

TWICE_SQL = """
twice AS (
  SELECT p_partkey AS app_id, p_name AS name, 1 AS seq FROM part
  UNION ALL SELECT p_partkey, p_type, 2 FROM part)"""


def _twice(spark, sf_dir):
    """Every part listed twice, the second time under its type."""
    part = load(spark, sf_dir, "part")
    first = part.select(F.col("p_partkey").alias("app_id"), F.col("p_name").alias("name"))
    second = part.select(F.col("p_partkey").alias("app_id"), F.col("p_type").alias("name"))
    return first.withColumn("seq", F.lit(1)).unionByName(second.withColumn("seq", F.lit(2)))


JOIN_SQL = f"""
WITH {GAMES_SQL}, {REVIEWS_SQL}
SELECT app_id, name, count(*) AS stat FROM games JOIN reviews USING (app_id)
GROUP BY app_id, name"""


@query("count_join", JOIN_SQL)
def count_join(spark, sf_dir):
    return op.game_review_counts(games(spark, sf_dir), reviews(spark, sf_dir))


@query("count_join_union", JOIN_SQL)
def count_join_union(spark, sf_dir):
    return op.game_review_counts_by_union(games(spark, sf_dir), reviews(spark, sf_dir))


@query("join_latest_name", f"""
WITH {TWICE_SQL}, {REVIEWS_SQL}, newest AS (
  SELECT app_id, arg_max(name, seq) AS name FROM twice GROUP BY app_id)
SELECT app_id, name, count(*) AS stat FROM newest JOIN reviews USING (app_id)
GROUP BY app_id, name""")
def join_latest_name(spark, sf_dir):
    return op.game_review_counts(_twice(spark, sf_dir), reviews(spark, sf_dir), seq="seq")


@query("join_concat_names", f"""
WITH {TWICE_SQL}, {REVIEWS_SQL}
SELECT app_id, string_agg(DISTINCT name, ',' ORDER BY name) AS name, count(*) AS stat
FROM twice JOIN reviews USING (app_id) GROUP BY app_id""")
def join_concat_names(spark, sf_dir):
    merged = op.game_review_counts(
        _twice(spark, sf_dir), reviews(spark, sf_dir), names="concat"
    )
    return merged.orderBy("app_id")


@query("latest_names", f"WITH {TWICE_SQL} "
       "SELECT app_id, arg_max(name, seq) AS name FROM twice GROUP BY app_id")
def latest_names(spark, sf_dir):
    return op.latest_names(_twice(spark, sf_dir), "seq")


@query("review_counts", f"WITH {REVIEWS_SQL} "
       "SELECT app_id, count(*) AS stat FROM reviews GROUP BY app_id")
def review_counts(spark, sf_dir):
    return op.review_counts(reviews(spark, sf_dir))


@query("stat_ascending", f"{JOIN_SQL} ORDER BY stat, app_id")
def stat_ascending(spark, sf_dir):
    return op.ascending(op.game_review_counts(games(spark, sf_dir), reviews(spark, sf_dir)))
