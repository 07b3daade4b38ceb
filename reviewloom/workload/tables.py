"""How the given tables are read as catalogues, reviews and streams.

=========  =============================  =======================================
binding    games                          reviews
=========  =============================  =======================================
parts      part, genres = words of name   lineitem, R is 1, A is -1, N is 0
orders     orders, genre = priority       none
texts      sources of documents           documents with a label, 1 good, -1 bad
=========  =============================  =======================================

``event_rows`` reads events as batches of several tenants. For each frame there is
a ``WITH`` fragment that builds the same rows in SQL.
"""

from pyspark.sql import functions as F

from ..sources import spread

BATCH_ROWS = 100


# Columns in use, so that no file is opened to find them. Tables that are not
# listed bring their own types for dates.
SCHEMAS = {
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_quantity double, "
                "l_returnflag string, l_linestatus string",
    "documents": "doc_id bigint, text string, lang string, source string",
    "labels": "doc_id bigint, quality int",
}


def load(spark, sf_dir, table):
    reader = spark.read.schema(SCHEMAS[table]) if table in SCHEMAS else spark.read
    return reader.parquet(f"{sf_dir}/{table}.parquet")


def texts(spark, sf_dir):
    """The documents, spread over all cores for work on their texts."""
    return spread(load(spark, sf_dir, "documents"), "doc_id")


GAMES_SQL = """
games AS (
  SELECT p_partkey AS app_id, p_name AS name, string_split(p_name, ' ') AS genres,
         CAST(p_size AS BIGINT) AS avg_playtime,
         p_size % 2 = 0 AS windows, p_size % 3 = 0 AS mac, p_size % 5 = 0 AS linux
  FROM part)"""


def games(spark, sf_dir):
    return load(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("app_id"),
        F.col("p_name").alias("name"),
        F.split("p_name", " ").alias("genres"),
        F.col("p_size").cast("bigint").alias("avg_playtime"),
        (F.col("p_size") % 2 == 0).alias("windows"),
        (F.col("p_size") % 3 == 0).alias("mac"),
        (F.col("p_size") % 5 == 0).alias("linux"),
    )


REVIEWS_SQL = """
reviews AS (
  SELECT l_partkey AS app_id,
         CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN -1 ELSE 0 END AS score
  FROM lineitem)"""


def reviews(spark, sf_dir, text=None):
    flag = F.col("l_returnflag")
    return load(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("app_id"),
        F.when(flag == "R", 1).when(flag == "A", -1).otherwise(0).cast("tinyint").alias("score"),
        *([F.col(text).alias("text")] if text else []),
    )


TENANTS_SQL = """
games AS (
  SELECT p_size % 3 + 1 AS client_id, p_partkey AS app_id, p_name AS name,
         string_split(p_name, ' ') AS genres, CAST(p_size AS BIGINT) AS avg_playtime,
         1990 + p_size AS release_year,
         p_size % 2 = 0 AS windows, p_size % 3 = 0 AS mac, p_size % 5 = 0 AS linux
  FROM part),
reviews AS (
  SELECT l_linenumber % 3 + 1 AS client_id, l_partkey AS app_id,
         CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN -1 ELSE 0 END AS score
  FROM lineitem)"""


def tenant_games(part):
    """Parts as the catalogues of three tenants; ``part`` may be a stream."""
    size = F.col("p_size")
    return part.select(
        (size % 3 + 1).cast("bigint").alias("client_id"),
        F.col("p_partkey").alias("app_id"),
        F.col("p_name").alias("name"),
        F.split("p_name", " ").alias("genres"),
        size.cast("bigint").alias("avg_playtime"),
        (size + 1990).alias("release_year"),
        (size % 2 == 0).alias("windows"),
        (size % 3 == 0).alias("mac"),
        (size % 5 == 0).alias("linux"),
        F.lit(1).cast("bigint").alias("seq"),
    )


def tenant_reviews(lineitem):
    """Line items as reviews; those of a part in another tenant's catalogue do not count."""
    flag = F.col("l_returnflag")
    return lineitem.select(
        (F.col("l_linenumber") % 3 + 1).cast("bigint").alias("client_id"),
        F.col("l_partkey").alias("app_id"),
        F.when(flag == "R", 1).when(flag == "A", -1).otherwise(0).cast("tinyint").alias("score"),
    )


def load_stream(spark, sf_dir, table):
    """A file stream over a table."""
    schema = load(spark, sf_dir, table).schema
    # A pattern, so that both a single file and a folder of files can be streamed.
    pattern = f"{table[:-1]}[{table[-1]}].parquet"
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{pattern}")


ORDER_GAMES_SQL = """
games AS (
  SELECT o_orderkey AS app_id, o_orderstatus AS name, [o_orderpriority] AS genres,
         CAST(floor(o_totalprice) AS BIGINT) AS avg_playtime,
         CAST(year(o_orderdate) AS INTEGER) AS release_year,
         strftime(o_orderdate, '%b %d, %Y') AS release_date
  FROM orders)"""


def order_games(spark, sf_dir):
    return load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("app_id"),
        F.col("o_orderstatus").alias("name"),
        F.array("o_orderpriority").alias("genres"),
        F.floor("o_totalprice").cast("bigint").alias("avg_playtime"),
        F.year("o_orderdate").alias("release_year"),
        F.date_format("o_orderdate", "MMM dd, yyyy").alias("release_date"),
    )


TEXT_GAMES_SQL = """
games AS (
  SELECT CAST(substring(source, 4) AS BIGINT) AS app_id, source AS name,
         list(DISTINCT lang) AS genres
  FROM documents GROUP BY source)"""


def text_games(spark, sf_dir):
    """Sources as games; their genres are the languages they publish in."""
    by_source = load(spark, sf_dir, "documents").groupBy("source").agg(
        F.collect_set("lang").alias("genres")
    )
    return by_source.select(
        F.substring("source", 4, 20).cast("bigint").alias("app_id"),
        F.col("source").alias("name"),
        "genres",
    )


TEXT_REVIEWS_SQL = """
reviews AS (
  SELECT doc_id, CAST(substring(source, 4) AS BIGINT) AS app_id, text, lang,
         CASE quality WHEN 1 THEN 1 ELSE -1 END AS score
  FROM documents JOIN labels USING (doc_id))"""


ALL_REVIEWS_SQL = """
all_reviews AS (
  SELECT doc_id, text, lang, CASE quality WHEN 1 THEN 1 WHEN 0 THEN -1 ELSE 0 END AS score
  FROM documents LEFT JOIN labels USING (doc_id))"""


def all_text_reviews(spark, sf_dir):
    """Every document; those without a label score 0."""
    labels = load(spark, sf_dir, "labels").select("doc_id", "quality")
    score = F.when(F.col("quality") == 1, 1).when(F.col("quality") == 0, -1).otherwise(0)
    return texts(spark, sf_dir).join(labels, "doc_id", "left").select(
        "doc_id", "lang", "text", score.cast("tinyint").alias("score"))


def text_reviews(spark, sf_dir):
    labels = load(spark, sf_dir, "labels").select("doc_id", "quality")
    return texts(spark, sf_dir).join(labels, "doc_id").select(
        "doc_id",
        F.substring("source", 4, 20).cast("bigint").alias("app_id"),
        "text",
        "lang",
        F.when(F.col("quality") == 1, 1).otherwise(-1).cast("tinyint").alias("score"),
    )


EVENT_ROWS_SQL = f"""
last AS (SELECT max(event_id) AS last_id FROM events),
event_rows AS (
  SELECT user_id % 3 + 1 AS client_id, user_id AS app_id, event_type AS input,
         event_id // {BATCH_ROWS} AS batch_id, event_id % {BATCH_ROWS} AS row_no,
         event_id // {BATCH_ROWS} = last_id // {BATCH_ROWS} AS eof,
         event_id AS seq, props, value
  FROM events, last)"""


def event_rows(events, last_id):
    """Events as rows of numbered batches of three tenants.

    The input of a row is its event type. ``last_id`` is the largest event id;
    the batch that holds it is the last one.
    """
    batch = F.floor(F.col("event_id") / BATCH_ROWS).cast("bigint")
    return events.select(
        (F.col("user_id") % 3 + 1).alias("client_id"),
        F.col("user_id").alias("app_id"),
        F.col("event_type").alias("input"),
        batch.alias("batch_id"),
        (F.col("event_id") % BATCH_ROWS).alias("row_no"),
        (batch == F.floor(last_id / BATCH_ROWS)).alias("eof"),
        F.col("event_id").alias("seq"),
        "props",
        "value",
    )


def stored_event_rows(spark, sf_dir):
    events = load(spark, sf_dir, "events")
    return event_rows(events, events.agg(F.max("event_id").alias("last_id")).scalar())


def streamed_event_rows(spark, sf_dir):
    """The same rows from a file stream over the events table.

    A stream does not know its end; where it stops is read from the stored table.
    """
    last_id = load(spark, sf_dir, "events").agg(F.max("event_id")).first()[0]
    return event_rows(load_stream(spark, sf_dir, "events"), F.lit(last_id).cast("bigint"))
