"""Exact running totals over a whole table without sorting it in one task."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stored

BLOCK_BITS = 20
TOP_BITS = 24


def running_total(df, key, weight=None, by=(), out="upto", key_bits=64, keep=False):
    """Add the sum of ``weight`` over all rows of the ``by`` group up to this key.

    ``key`` is an integer column that is unique within ``by``; without ``weight``
    the total is the row's 1-based position. The key range is cut into nested
    blocks of 2**20 values: totals of blocks, and of blocks of blocks, give each
    block the total before it. As keys are unique, a window holds at most 2**20
    rows, and the one over the outermost blocks 2**24 pairs of numbers, whatever
    the size or the distribution of the table. Where keys are known to stay below
    2**key_bits, a smaller ``key_bits`` saves levels; the totals do not depend on it.
    ``df`` is computed twice, or once more for each further level if its shuffle cannot be
    used again; ``keep`` stores the totals of the first level, for a ``df`` costly to compute.
    """
    by = list(by)
    rows = df.withColumns({
        "_total_block": F.shiftright(F.col(key).cast("bigint"), BLOCK_BITS),
        "_total_sum": F.lit(1).cast("bigint") if weight is None else F.col(weight),
    })
    levels = [rows]
    while len(levels) == 1 or key_bits - BLOCK_BITS * (len(levels) - 1) > TOP_BITS:
        blocks = levels[-1].groupBy(*by, F.col("_total_block").alias("_total_inner")).agg(
            F.sum("_total_sum").alias("_total_sum")
        )
        if keep and len(levels) == 1:
            blocks = stored(blocks, "blocks")
        levels.append(blocks.withColumn("_total_block", F.shiftright("_total_inner", BLOCK_BITS)))

    before = _before(levels.pop(), by, F.lit(0))
    while len(levels) > 1:
        blocks = levels.pop().join(before, [*by, "_total_block"])
        before = _before(blocks, [*by, "_total_block"], F.col("_total_before"))
    inside = W.partitionBy(*by, "_total_block").orderBy(key).rowsBetween(W.unboundedPreceding, 0)
    return (
        rows.join(before, [*by, "_total_block"])
        .withColumn(out, F.col("_total_before") + F.sum("_total_sum").over(inside))
        .select(*df.columns, out)
    )


def _before(blocks, group, offset):
    """Per inner block: the sum over all blocks before it."""
    window = W.partitionBy(*group).orderBy("_total_inner").rowsBetween(W.unboundedPreceding, 0)
    earlier = F.sum("_total_sum").over(window) - F.col("_total_sum")
    by = [name for name in group if name != "_total_block"]
    return blocks.select(
        *by, F.col("_total_inner").alias("_total_block"), (offset + earlier).alias("_total_before")
    )
