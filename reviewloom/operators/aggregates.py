"""Aggregations with a map-side partial step."""

from pyspark.sql import Observation
from pyspark.sql import functions as F


def count_flags(df, flags, by=()):
    """Count the true values of several flags in one pass.

    ``flags`` maps an output name to a boolean column.
    """
    counts = [F.count_if(flag).alias(name) for name, flag in flags.items()]
    return df.groupBy(*by).agg(*counts) if by else df.agg(*counts)


def stage_counts(df, stages):
    """Rows that pass each named condition, as one row per stage."""
    counts = df.agg(*[F.count_if(condition).alias(name) for name, condition in stages.items()])
    pairs = [F.struct(F.lit(name).alias("stage"), F.col(f"`{name}`").alias("n")) for name in stages]
    return counts.select(F.inline(F.array(*pairs)))


def watched(df, stages):
    """The same rows, and an observation that counts those that pass each condition.

    The counts come with the first action over the returned frame, without a scan of
    their own: ``observed_counts`` gives them once it has ended. Put it right above the
    scan and write without a shuffle behind it, so that a task run again counts once.
    """
    seen = Observation()
    return df.observe(seen, *[F.count_if(condition).alias(name) for name, condition in stages.items()]), seen


def observed_counts(spark, seen, label="stage"):
    """(label, n) of an observation whose action has ended."""
    return spark.createDataFrame(sorted(seen.get.items()), f"{label} string, n bigint")


def review_counts(reviews, by=()):
    """Reviews per game. A hot game shrinks to one row per task before the shuffle."""
    return reviews.groupBy(*by, "app_id").agg(F.count(F.lit(1)).alias("stat"))


def latest_names(games, seq=None, by=()):
    """One name per app_id: the one with the largest ``seq``.

    Rows have no arrival order in Spark, so the order must be a column. Names
    that tie, or all of them where ``seq`` is not given, go to the larger name.
    """
    keys = [*by, "app_id"]
    if seq is None:
        return games.groupBy(*keys).agg(F.max("name").alias("name"))
    newest = F.max(F.struct(F.col(seq), F.col("name")))
    return games.groupBy(*keys).agg(newest["name"].alias("name"))
