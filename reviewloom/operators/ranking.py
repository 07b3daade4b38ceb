"""Top-N, sorted output and percentile cuts over (key, ..., stat) rows."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .positions import running_total

# A count of reviews stays below 2**40, about 10**12.
STAT_BITS = 40
# Spark itself cuts ranks per task, before the shuffle, only below this many.
CUT_PER_TASK = 1000
LANES = 64


def top_n(stats, n, by=(), stat="stat", key="app_id"):
    """The n rows with the largest stat; ties go to the smaller key.

    Without ``by`` this is a partial top-n per task and one merge of n rows each.
    With ``by`` the ranks are cut per task before the shuffle as well. For large n, where
    Spark does not do that, they are cut within lanes of a group first, and then among
    what the lanes keep, so that a large group is sorted by many tasks whatever n is.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    order = [F.desc(stat), F.asc(key)]
    if not by:
        return stats.orderBy(*order).limit(n)
    cut = stats.withColumn("_lane", F.pmod(F.xxhash64(key), F.lit(LANES)))
    for group in ([*by, "_lane"], [*by])[n < CUT_PER_TASK:]:
        rank = F.row_number().over(W.partitionBy(*group).orderBy(*order))
        cut = cut.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")
    return cut.drop("_lane")


def ascending(stats, stat="stat", key="app_id"):
    """Range-partitioned sort by stat, then key."""
    return stats.orderBy(stat, key)


def percentile_cut(
    stats, p, by=(), method="nearest", ties="cut", stat="stat", key="app_id", counted=None
):
    """Rows at or above the p-th percentile of an integer stat.

    ``method='nearest'`` sorts ascending and starts at 0-based position
    ``max(0, ceil(p / 100 * n) - 1)``. ``ties='cut'`` keeps exactly the rows from
    that position on: of the rows equal to the value found there, those with the
    smallest keys stay. ``ties='keep'`` keeps all of them. ``method='linear'``
    interpolates between the two nearest ranks and keeps every row ``>=`` that.

    Only a histogram (one row per distinct stat) is ranked, by running totals of
    bounded blocks; the rows themselves are compared with the cut. ``stats`` is read
    several times: store it where it is costly to compute. ``counted`` is the histogram,
    with the number of rows per stat as ``games``, where it is known already.
    """
    if not 0 <= p <= 100:
        raise ValueError("p must be between 0 and 100")
    if method not in ("nearest", "linear"):
        raise ValueError(f"unknown method: {method}")
    if ties not in ("cut", "keep"):
        raise ValueError(f"unknown ties rule: {ties}")
    by = list(by)
    if counted is None:
        histogram = stats.groupBy(*by, F.col(stat).alias("_value")).agg(F.count(F.lit(1)).alias("_n"))
    else:
        histogram = counted.select(*by, F.col(stat).alias("_value"), F.col("games").alias("_n"))
    sizes = histogram.groupBy(*by).agg(F.sum("_n").alias("_size"))
    upto = running_total(histogram, "_value", "_n", by, out="_upto", key_bits=STAT_BITS)
    ranked = _attach(upto, sizes, by)

    if method == "linear":
        cut = _linear_cut(ranked, p, by)
        return _attach(stats, cut, by).filter(F.col(stat) >= F.col("_cut")).select(*stats.columns)

    first = F.greatest(F.lit(0), F.ceil(F.lit(p / 100.0) * F.col("_size")) - 1).cast("bigint")
    cut = (
        ranked.withColumn("_first", first)
        .filter(F.col("_upto") > F.col("_first"))
        .groupBy(*by)
        .agg(
            F.min("_value").alias("_cut"),
            F.min(F.col("_upto") - F.col("_first")).alias("_quota"),
        )
    )
    marked = _attach(stats, cut, by)
    if ties == "keep":
        return marked.filter(F.col(stat) >= F.col("_cut")).select(*stats.columns)
    above = marked.filter(F.col(stat) > F.col("_cut"))
    tied = running_total(marked.filter(F.col(stat) == F.col("_cut")), key, by=by, out="_place")
    kept = tied.filter(F.col("_place") <= F.col("_quota"))
    return above.select(*stats.columns).unionByName(kept.select(*stats.columns))


def _linear_cut(ranked, p, by):
    rank = F.lit(p / 100.0) * (F.col("_size") - 1)
    low = F.min(F.when(F.col("_upto") > F.floor(rank), F.col("_value")))
    high = F.min(F.when(F.col("_upto") > F.ceil(rank), F.col("_value")))
    part = F.max(rank - F.floor(rank))
    return ranked.groupBy(*by).agg((low + (high - low) * part).alias("_cut"))


def _attach(df, values, by):
    """Add columns of a frame with one row per ``by`` group (one row without)."""
    if by:
        return df.join(values, by)
    packed = values.select(F.struct("*").alias("_packed"))
    return df.withColumn("_packed", packed.scalar()).select(*df.columns, "_packed.*")
