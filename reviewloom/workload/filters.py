"""Filters, routing, samples, unions and comparisons on their own."""

from pyspark.sql import functions as F

from .. import operators as op
from ..session import shared_dir
from ..sources import write_buckets, write_copy
from .registry import query
from .tables import (
    GAMES_SQL,
    ORDER_GAMES_SQL,
    REVIEWS_SQL,
    games,
    load,
    order_games,
    reviews,
)


@query("genre_exact", f"WITH {GAMES_SQL} "
       "SELECT app_id, name FROM games WHERE list_contains(genres, 'small')")
def genre_exact(spark, sf_dir):
    return op.by_genre(games(spark, sf_dir), "small").select("app_id", "name")


@query("genre_substring", f"WITH {GAMES_SQL} "
       "SELECT app_id, name FROM games "
       "WHERE contains(lower(array_to_string(genres, ',')), 're')")
def genre_substring(spark, sf_dir):
    return op.by_genre(games(spark, sf_dir), "RE", match="substring").select("app_id", "name")


@query("decade_year", f"WITH {ORDER_GAMES_SQL} "
       "SELECT app_id, release_year FROM games "
       "WHERE contains(CAST(release_year AS VARCHAR), '199')")
def decade_year(spark, sf_dir):
    return op.by_decade(order_games(spark, sf_dir), 1990).select("app_id", "release_year")


@query("decade_text", f"WITH {ORDER_GAMES_SQL} "
       "SELECT app_id, release_date FROM games WHERE contains(release_date, '200')")
def decade_text(spark, sf_dir):
    chosen = op.by_decade(order_games(spark, sf_dir), 2000, date_text="release_date")
    return chosen.select("app_id", "release_date")


@query("score_split", f"""
WITH {REVIEWS_SQL}
SELECT app_id, CAST(sum(CASE WHEN score = 1 THEN 1 ELSE 0 END) AS BIGINT) AS positive,
       CAST(sum(CASE WHEN score <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS negative
FROM reviews GROUP BY app_id""")
def score_split(spark, sf_dir):
    flags = {"positive": F.col("score") == 1, "negative": F.col("score") != 1}
    return op.count_flags(reviews(spark, sf_dir), flags, by=("app_id",))


@query("score_equality", f"""
WITH {REVIEWS_SQL}
SELECT app_id, count(*) AS stat FROM reviews WHERE score = -1 GROUP BY app_id""")
def score_equality(spark, sf_dir):
    return op.review_counts(op.by_polarity(reviews(spark, sf_dir), "negative", "minus_one"))


@query("single_key", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity "
       "FROM lineitem WHERE l_partkey = 57")
def single_key(spark, sf_dir):
    rows = op.by_key(load(spark, sf_dir, "lineitem"), 57, "l_partkey")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("dropna_subset", """
SELECT doc_id, lang, quality FROM documents LEFT JOIN labels USING (doc_id)
WHERE quality IS NOT NULL AND lang IS NOT NULL""")
def dropna_subset(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").join(
        load(spark, sf_dir, "labels"), "doc_id", "left"
    )
    return op.complete_rows(docs, ["doc_id", "lang", "quality"])


def _genre_routes():
    return {
        "small": F.array_contains("genres", "small"),
        "ring": F.array_contains("genres", "ring"),
        "velvet": F.array_contains("genres", "velvet"),
    }


ROUTED_SQL = f"""
WITH {GAMES_SQL}, routed AS (
  SELECT route, app_id FROM games, (VALUES ('small'), ('ring'), ('velvet')) AS r(route)
  WHERE list_contains(genres, route))"""


@query("route_counts", f"{ROUTED_SQL} SELECT route, count(*) AS n FROM routed GROUP BY route")
def route_counts(spark, sf_dir):
    return op.route_counts(games(spark, sf_dir), _genre_routes())


@query("route_rows", f"{ROUTED_SQL} SELECT app_id, route FROM routed")
def route_rows(spark, sf_dir):
    return op.route(games(spark, sf_dir), _genre_routes()).select("app_id", "route")


@query("bucket_counts", f"WITH {REVIEWS_SQL} "
       "SELECT app_id % 3 + 1 AS bucket, count(*) AS n FROM reviews GROUP BY 1")
def bucket_counts(spark, sf_dir):
    return op.bucket_counts(reviews(spark, sf_dir), "app_id", 3)


@query("bucket_folders", f"WITH {GAMES_SQL} "
       "SELECT app_id, name, CAST(app_id % 3 + 1 AS INTEGER) AS bucket FROM games")
def bucket_folders(spark, sf_dir):
    path = shared_dir(spark, "buckets")
    write_buckets(games(spark, sf_dir).select("app_id", "name"), path, "app_id", 3)
    return spark.read.parquet(path)


@query("co_located_join", f"""
WITH {GAMES_SQL}, {REVIEWS_SQL}
SELECT name, score, count(*) AS n FROM games JOIN reviews USING (app_id) GROUP BY name, score""")
def co_located_join(spark, sf_dir):
    flags = reviews(spark, sf_dir).groupBy("app_id", "score").agg(F.count(F.lit(1)).alias("n"))
    left, right = op.co_located([games(spark, sf_dir), flags], "app_id", 8)
    joined = left.join(right, "app_id")
    return joined.groupBy("name", F.col("score").cast("int").alias("score")).agg(
        F.sum("n").alias("n")
    )


def _stages():
    return {
        "all": F.lit(True),
        "small": F.array_contains("genres", "small"),
        "small and cheap": F.array_contains("genres", "small") & (F.col("avg_playtime") < 10),
        "linux": F.col("linux"),
    }


STAGES_SQL = f"""
WITH {GAMES_SQL}
SELECT 'all' AS stage, count(*) AS n FROM games
UNION ALL SELECT 'small', count(*) FROM games WHERE list_contains(genres, 'small')
UNION ALL SELECT 'small and cheap', count(*) FROM games
  WHERE list_contains(genres, 'small') AND avg_playtime < 10
UNION ALL SELECT 'linux', count(*) FROM games WHERE linux"""


@query("stage_counts", STAGES_SQL)
def stage_counts(spark, sf_dir):
    return op.stage_counts(games(spark, sf_dir), _stages())


@query("stage_counts_observed", STAGES_SQL)
def stage_counts_observed(spark, sf_dir):
    """The same, counted by the job that writes the rows of one stage."""
    rows, seen = op.watched(games(spark, sf_dir), _stages())
    write_copy(rows.filter("linux"), shared_dir(spark, "linux-games"), "parquet")
    return op.observed_counts(spark, seen)


@query("reduced_reviews", f"""
WITH {REVIEWS_SQL}
SELECT app_id, CAST(score AS TINYINT) AS score FROM reviews
WHERE app_id IN (SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 100)""")
def reduced_reviews(spark, sf_dir):
    return op.reduced_reviews(games(spark, sf_dir), reviews(spark, sf_dir), 100)


@query("reduced_games", f"""
WITH {GAMES_SQL} SELECT app_id, name FROM games ORDER BY app_id LIMIT 100""")
def reduced_games(spark, sf_dir):
    return op.reduced_games(games(spark, sf_dir), 100).select("app_id", "name")


@query("chunk_head", """
WITH placed AS (
  SELECT doc_id, lang, quality, row_number() OVER (ORDER BY doc_id) AS place
  FROM documents LEFT JOIN labels USING (doc_id))
SELECT doc_id, lang, quality FROM placed WHERE quality IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY (place - 1) // 64 ORDER BY doc_id) <= 10""")
def chunk_head(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").join(
        load(spark, sf_dir, "labels"), "doc_id", "left"
    ).select("doc_id", "lang", "quality")
    return op.chunk_head(docs, "doc_id", 64, 10, required=["quality"])


@query("running_total", """
SELECT o_orderkey, CAST(sum(n) OVER (ORDER BY o_orderkey) AS BIGINT) AS upto
FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS n FROM orders)""")
def running_total(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").select(
        "o_orderkey", F.floor("o_totalprice").cast("bigint").alias("n")
    )
    return op.running_total(orders, "o_orderkey", "n").select("o_orderkey", "upto")


@query("union_partitions", f"""
WITH {REVIEWS_SQL}, stats AS (
  SELECT app_id, count(*) AS stat, row_number() OVER (ORDER BY app_id) - 1 AS place,
         count(*) OVER () - 1 AS last
  FROM reviews GROUP BY app_id)
SELECT app_id, stat, place // 100 AS batch_id, place % 100 AS row_no,
       place // 100 = last // 100 AS eof
FROM stats""")
def union_partitions(spark, sf_dir):
    """Counts of the three key partitions, merged and renumbered."""
    counts = op.review_counts(reviews(spark, sf_dir))
    parts = op.routed(counts, {i: F.col("app_id") % 3 + 1 == i for i in (1, 2, 3)})
    return op.renumber(op.union_partitions(list(parts.values())), 100)


def _negative_counts(spark, sf_dir, negative):
    return op.review_counts(op.by_polarity(reviews(spark, sf_dir), "negative", negative))


TWO_COUNTS_SQL = f"""
WITH {REVIEWS_SQL},
a AS (SELECT app_id, count(*) AS stat FROM reviews WHERE score = -1 GROUP BY app_id),
b AS (SELECT app_id, count(*) AS stat FROM reviews WHERE score <> 1 GROUP BY app_id)"""


@query("compare_ordered", f"""{TWO_COUNTS_SQL},
x AS (SELECT *, row_number() OVER (ORDER BY app_id) AS place FROM a),
y AS (SELECT *, row_number() OVER (ORDER BY app_id) AS place FROM b)
SELECT place, x.app_id AS left_app_id, x.stat AS left_stat,
       y.app_id AS right_app_id, y.stat AS right_stat
FROM x FULL JOIN y USING (place)
WHERE x.app_id IS DISTINCT FROM y.app_id OR x.stat IS DISTINCT FROM y.stat""")
def compare_ordered(spark, sf_dir):
    left, right = [
        op.running_total(_negative_counts(spark, sf_dir, rule), "app_id", out="place")
        for rule in ("minus_one", "not_positive")
    ]
    return op.compare_ordered(left, right, "place")


@query("compare_unordered", f"""{TWO_COUNTS_SQL},
x AS (SELECT * FROM a EXCEPT ALL SELECT * FROM b),
y AS (SELECT * FROM b EXCEPT ALL SELECT * FROM a)
SELECT app_id, stat, CAST(count(*) AS BIGINT) AS extra, CAST(0 AS BIGINT) AS missing
FROM x GROUP BY ALL
UNION ALL
SELECT app_id, stat, CAST(0 AS BIGINT), CAST(count(*) AS BIGINT) FROM y GROUP BY ALL""")
def compare_unordered(spark, sf_dir):
    return op.compare_unordered(
        _negative_counts(spark, sf_dir, "minus_one"),
        _negative_counts(spark, sf_dir, "not_positive"),
    )
