"""Union of partitioned streams of grouped rows."""

from functools import reduce

from pyspark.sql import functions as F

from .positions import running_total


def union_partitions(parts):
    """One frame out of the frames of all partitions; no shuffle."""
    return reduce(lambda left, right: left.unionByName(right), parts)


def renumber(df, batch_size, key="app_id"):
    """Cut a frame into consecutive batches in key order.

    Adds ``batch_id`` from 0, ``row_no`` within the batch, and ``eof`` on the rows
    of the last batch. The key must be unique.
    """
    position = F.col("_position") - 1
    last = df.agg((F.count(F.lit(1)) - 1).alias("last")).scalar()
    return running_total(df, key, out="_position").select(
        *df.columns,
        F.floor(position / batch_size).cast("bigint").alias("batch_id"),
        (position % batch_size).alias("row_no"),
        (F.floor(position / batch_size) == F.floor(last / batch_size)).alias("eof"),
    )
