"""Smaller, well-defined versions of a dataset."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .joins import only_listed
from .positions import running_total


def reduced_games(games, n, key="app_id"):
    """The first n catalogue rows in key order; with the readers' ``place`` as key, in file order."""
    return games.orderBy(key).limit(n)


def reduced_reviews(games, reviews, n, key="app_id", order=None):
    """All reviews of the first n catalogue rows, in key order or by ``order``."""
    return only_listed(reviews, reduced_games(games, n, order or key), key)


def chunk_head(df, key, chunk_rows, k, required):
    """The first k complete rows of every chunk of consecutive rows.

    The table is cut into chunks of ``chunk_rows`` in the order of the unique
    integer ``key``; rows with a NULL in a ``required`` column are dropped after
    the cut, then the first k of the rest are kept. Positions are computed on the
    key alone; the wide rows only meet the kept keys.
    """
    complete = F.lit(True)
    for name in required:
        complete = complete & F.col(name).isNotNull()
    narrow = df.select(F.col(key).cast("bigint").alias(key), complete.alias("_complete"))
    placed = running_total(narrow, key, out="_position")
    chunk = F.floor((F.col("_position") - 1) / chunk_rows)
    rank = F.row_number().over(W.partitionBy("_chunk").orderBy(key))
    kept = (
        placed.withColumn("_chunk", chunk)
        .filter("_complete")
        .withColumn("_rank", rank)
        .filter(F.col("_rank") <= k)
    )
    return only_listed(df, kept, key)
