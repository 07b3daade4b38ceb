"""Send records to named routes, and partition them by key."""

from pyspark.sql import functions as F

from ..functions import bucket_of


def route(df, routes, tag="route"):
    """One row per record and route whose condition holds; 0..k rows per record.

    ``routes`` maps a route name to a boolean column.
    """
    names = F.array(*[F.when(condition, F.lit(name)) for name, condition in routes.items()])
    return df.withColumn(tag, F.explode(F.array_compact(names)))


def routed(df, routes):
    """One filtered frame per route, for consumers that read them separately.

    The frames share their lineage, not their work: ``persist()`` the input when
    several of them feed different actions.
    """
    return {name: df.filter(condition) for name, condition in routes.items()}


def route_counts(df, routes, tag="route"):
    """Records per route, in one pass and without multiplying the records.

    A route that no record takes has no row.
    """
    counts = df.agg(*[F.count_if(condition).alias(name) for name, condition in routes.items()])
    pairs = [F.struct(F.lit(name).alias(tag), F.col(f"`{name}`").alias("n")) for name in routes]
    return counts.select(F.inline(F.array(*pairs))).filter(F.col("n") > 0)


def co_located(frames, key, buckets):
    """Repartition several frames alike, so that later keyed joins do not shuffle."""
    return [frame.repartition(buckets, key) for frame in frames]


def bucket_counts(df, key, buckets):
    return df.groupBy(bucket_of(key, buckets).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
