"""Differences between two results."""

from pyspark.sql import functions as F


def compare_ordered(left, right, position):
    """Positions at which the two frames differ, with both rows.

    ``position`` is a unique column present in both. A row one side lacks counts
    as a difference. Columns come out as ``left_*`` and ``right_*``.
    """
    values = [name for name in left.columns if name != position]
    a = left.select(position, F.struct(*values).alias("_left"))
    b = right.select(position, F.struct(*values).alias("_right"))
    return (
        a.join(b, position, "full_outer")
        .filter(~F.col("_left").eqNullSafe(F.col("_right")))
        .select(
            position,
            *[F.col("_left")[name].alias(f"left_{name}") for name in values],
            *[F.col("_right")[name].alias(f"right_{name}") for name in values],
        )
    )


def compare_unordered(left, right):
    """Rows whose multiplicity differs, in one aggregation over both frames.

    ``extra`` counts the copies only the left frame has, ``missing`` those only
    the right one has.
    """
    columns = left.columns
    both = left.withColumn("_sign", F.lit(1)).unionByName(
        right.select(*columns).withColumn("_sign", F.lit(-1))
    )
    surplus = both.groupBy(*columns).agg(F.sum("_sign").alias("_surplus"))
    return surplus.filter(F.col("_surplus") != 0).select(
        *columns,
        F.greatest(F.col("_surplus"), F.lit(0)).cast("bigint").alias("extra"),
        F.greatest(-F.col("_surplus"), F.lit(0)).cast("bigint").alias("missing"),
    )


def paired(left, right, key, label):
    """Labels two detectors gave to the same row; NULL where one gave none."""
    a = left.select(key, F.col(label).alias(f"{label}_a"))
    b = right.select(key, F.col(label).alias(f"{label}_b"))
    return a.join(b, key, "full_outer")


def agreement(pairs, *labels):
    """Rows per combination of labels."""
    return pairs.groupBy(*labels).agg(F.count(F.lit(1)).alias("n"))
