"""Batch numbers and tenants over the stored events, and the questions by tenant."""

from pyspark.sql import functions as F

from .. import plans
from .. import streaming as st
from ..session import shared_dir
from .registry import query
from .tables import (
    EVENT_ROWS_SQL,
    TENANTS_SQL,
    load,
    stored_event_rows,
    tenant_games,
    tenant_reviews,
)


def _tenant_rows(spark, sf_dir):
    return stored_event_rows(spark, sf_dir).select(
        "client_id", "app_id", "input", "batch_id", "row_no", "value"
    )


@query("first_delivery", f"""
WITH {EVENT_ROWS_SQL}
SELECT client_id, app_id, input, batch_id, row_no,
       CASE batch_id % 2 WHEN 0 THEN -value ELSE value END AS value
FROM event_rows""")
def first_delivery(spark, sf_dir):
    """Every batch delivered twice with different values; even ones first by the copy."""
    rows = _tenant_rows(spark, sf_dir)
    original = rows.withColumn("arrival", F.lit(1))
    copy = rows.withColumns({
        "value": -F.col("value"),
        "arrival": F.when(F.col("batch_id") % 2 == 0, 0).otherwise(2),
    })
    return st.first_delivery(original.unionByName(copy), "arrival").drop("arrival")


COMPLETENESS_SQL = f"""
WITH {EVENT_ROWS_SQL}, state AS (
  SELECT client_id, input, max(batch_id) AS last_batch, count(DISTINCT batch_id) AS batches,
         bool_or(eof) AS eof
  FROM event_rows GROUP BY client_id, input)"""


@query("completeness", f"""{COMPLETENESS_SQL}
SELECT *, eof AND batches = last_batch + 1 AS complete FROM state""")
def completeness(spark, sf_dir):
    return st.completeness(stored_event_rows(spark, sf_dir))


@query("missing_batches", f"""{COMPLETENESS_SQL}
SELECT client_id, input, batch_id
FROM (SELECT client_id, input, unnest(range(0, last_batch + 1)) AS batch_id FROM state) AS expected
ANTI JOIN event_rows USING (client_id, input, batch_id)""")
def missing_batches(spark, sf_dir):
    return st.missing_batches(stored_event_rows(spark, sf_dir))


@query("senders", f"""
WITH {EVENT_ROWS_SQL}
SELECT client_id, batch_id, count(DISTINCT input) AS reported,
       count(DISTINCT input) = 5 AS complete
FROM event_rows GROUP BY client_id, batch_id""")
def senders(spark, sf_dir):
    rows = stored_event_rows(spark, sf_dir)
    return st.senders_complete(rows, 5, by=("client_id", "batch_id"), sender="input")


@query("tenant_late", f"""
WITH {EVENT_ROWS_SQL}, done AS (
  SELECT client_id FROM event_rows GROUP BY client_id
  HAVING max(seq) < (SELECT max(seq) FROM event_rows))
SELECT client_id, app_id, input, batch_id, row_no, value
FROM event_rows ANTI JOIN done USING (client_id)""")
def tenant_late(spark, sf_dir):
    """All tenants but the one with the last event are done; their rows are late."""
    rows = stored_event_rows(spark, sf_dir)
    last = rows.agg(F.max("seq").alias("last")).scalar()
    done = rows.groupBy("client_id").agg(F.max("seq").alias("seq")).filter(F.col("seq") < last)
    return st.drop_done(_tenant_rows(spark, sf_dir), done)


def _control(spark, action, client_id):
    schema = "action string, client_id bigint"
    return spark.createDataFrame([(action, client_id)], schema)


@query("tenant_purge_one", f"""
WITH {EVENT_ROWS_SQL}
SELECT client_id, app_id, count(*) AS n FROM event_rows WHERE client_id <> 2
GROUP BY client_id, app_id""")
def tenant_purge_one(spark, sf_dir):
    rows = st.live_rows(_tenant_rows(spark, sf_dir), _control(spark, "one", 2))
    return rows.groupBy("client_id", "app_id").agg(F.count(F.lit(1)).alias("n"))


@query("tenant_purge_upto", f"""
WITH {EVENT_ROWS_SQL}
SELECT client_id, app_id, count(*) AS n FROM event_rows WHERE client_id > 2
GROUP BY client_id, app_id""")
def tenant_purge_upto(spark, sf_dir):
    """The table is rewritten without the purged tenants."""
    path = shared_dir(spark, "purged")
    st.rewrite_without(_tenant_rows(spark, sf_dir), _control(spark, "upto", 2), path)
    rows = spark.read.parquet(path).withColumn("client_id", F.col("client_id").cast("bigint"))
    return rows.groupBy("client_id", "app_id").agg(F.count(F.lit(1)).alias("n"))


# The question a result of each event type stands for.
QUESTION_OF = {"click": 1, "error": 2, "purchase": 3, "signup": 4, "view": 5}


FIRST_RESULT_SQL = f"""
WITH {EVENT_ROWS_SQL}
SELECT client_id, CASE input WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3
       WHEN 'signup' THEN 4 WHEN 'view' THEN 5 END AS query_no,
       min(seq) AS seq, arg_min(value, seq) AS value
FROM event_rows GROUP BY client_id, input"""


def results(rows):
    number = F.coalesce(*[
        F.when(F.col("input") == name, F.lit(number)) for name, number in QUESTION_OF.items()
    ])
    return rows.select("client_id", number.alias("query_no"), "seq", "value")


@query("first_result", FIRST_RESULT_SQL)
def first_result(spark, sf_dir):
    return st.first_result(results(stored_event_rows(spark, sf_dir)), "seq")


def _catalogues(spark, sf_dir):
    games = tenant_games(load(spark, sf_dir, "part"))
    return games, tenant_reviews(load(spark, sf_dir, "lineitem"))


TENANT = ("client_id",)

TENANT_PLATFORMS_SQL = f"""
WITH {TENANTS_SQL}
SELECT CAST(client_id AS BIGINT) AS client_id, count(*) FILTER (linux) AS "Linux",
       count(*) FILTER (mac) AS "Mac", count(*) FILTER (windows) AS "Windows"
FROM games GROUP BY client_id"""


@query("tenant_platform_counts", TENANT_PLATFORMS_SQL)
def tenant_platform_counts(spark, sf_dir):
    games, _ = _catalogues(spark, sf_dir)
    return plans.platform_counts(games, TENANT)


TENANT_PLAYTIME_SQL = f"""
WITH {TENANTS_SQL}
SELECT CAST(client_id AS BIGINT) AS client_id, app_id, name, avg_playtime AS stat FROM games
WHERE list_contains(genres, 'small') AND contains(CAST(release_year AS VARCHAR), '201')
QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY avg_playtime DESC, app_id) <= 10"""


@query("tenant_top_playtime", TENANT_PLAYTIME_SQL)
def tenant_top_playtime(spark, sf_dir):
    games, _ = _catalogues(spark, sf_dir)
    return plans.top_playtime(games, "small", 2010, 10, by=TENANT)


def tenant_counts_sql(genre, condition):
    return f"""
WITH {TENANTS_SQL}, stats AS (
  SELECT CAST(client_id AS BIGINT) AS client_id, app_id, name, count(*) AS stat
  FROM games JOIN reviews USING (client_id, app_id)
  WHERE list_contains(genres, '{genre}') AND {condition}
  GROUP BY client_id, app_id, name)"""


TENANT_TOP_SQL = f"""{tenant_counts_sql("small", "score = 1")}
SELECT client_id, app_id, name, stat FROM stats
QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY stat DESC, app_id) <= 5"""


@query("tenant_top_reviewed", TENANT_TOP_SQL)
def tenant_top_reviewed(spark, sf_dir):
    return plans.top_reviewed(*_catalogues(spark, sf_dir), "small", n=5, by=TENANT)


TENANT_OVER_SQL = f"""{tenant_counts_sql("large", "score <> 1")}
SELECT client_id, app_id, name, stat FROM stats WHERE stat > 8"""


@query("tenant_over_threshold", TENANT_OVER_SQL)
def tenant_over_threshold(spark, sf_dir):
    return plans.over_threshold(*_catalogues(spark, sf_dir), "large", 8, by=TENANT)


TENANT_PERCENTILE_SQL = f"""{tenant_counts_sql("large", "score <> 1")}, placed AS (
  SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY stat, app_id DESC) AS place,
         count(*) OVER (PARTITION BY client_id) AS n
  FROM stats)
SELECT client_id, app_id, name, stat FROM placed
WHERE place > greatest(0, CAST(ceil(CAST(90 AS DOUBLE) / 100 * n) AS BIGINT) - 1)"""


@query("tenant_percentile", TENANT_PERCENTILE_SQL)
def tenant_percentile(spark, sf_dir):
    return plans.percentile_question(*_catalogues(spark, sf_dir), "large", 90, by=TENANT)
