"""Keyed joins of the catalogue with its reviews.

The reviews are always counted per key before they meet the catalogue: what is
shuffled is at most one row per task and game, never a review. Both sides end up
hash-partitioned by app_id, so the join itself adds no exchange; whether one side
is broadcast is left to its measured size (AQE, autoBroadcastJoinThreshold).
"""

from pyspark.sql import functions as F

from .aggregates import latest_names, review_counts
from .filters import non_empty, only_if

#: 256 kB: of a million listed keys' bitmap about 60% stays empty
FILTER_BITS = 1 << 21


def game_review_counts(games, reviews, names="last", seq=None, by=()):
    """(app_id, name, stat) for every game with at least one review.

    ``names='last'``: several catalogue rows of one app_id are one game, named by
    the newest row. ``names='concat'``: they multiply its reviews, and the
    distinct names are joined by commas in ascending order. ``by`` names columns,
    such as the tenant, that keep catalogues and reviews apart.
    """
    return named_counts(games, review_counts(reviews, by), names, seq, by)


def named_counts(games, counts, names="last", seq=None, by=()):
    """The same from counts per game, for counts that serve several questions."""
    keys = [*by, "app_id"]
    if names == "last":
        return latest_names(games, seq, by).join(counts, keys).select(*keys, "name", "stat")
    if names == "concat":
        per_name = games.groupBy(*keys, "name").agg(F.count(F.lit(1)).alias("copies"))
        merged = per_name.groupBy(*keys).agg(
            F.array_join(F.array_sort(F.collect_list("name")), ",").alias("name"),
            F.sum("copies").alias("copies"),
        )
        return merged.join(counts, keys).select(
            *keys, "name", (F.col("stat") * F.col("copies")).alias("stat")
        )
    raise ValueError(f"unknown names rule: {names}")


def game_review_counts_by_union(games, reviews, seq=None, by=()):
    """The same answer as ``names='last'`` from one keyed upsert over both inputs.

    Names and counts meet in one aggregation, whichever side arrives first. Useful
    where the inputs come as one tagged stream.
    """
    keys = [*by, "app_id"]
    order = F.col(seq) if seq else F.lit(0)
    named = games.select(*keys, F.struct(order.alias("seq"), "name").alias("named"))
    both = named.unionByName(review_counts(reviews, by), allowMissingColumns=True)
    merged = both.groupBy(*keys).agg(
        F.max("named")["name"].alias("name"),
        F.coalesce(F.sum("stat"), F.lit(0)).cast("bigint").alias("stat"),
    )
    return non_empty(merged)


def only_listed(df, ids, key="app_id"):
    """Rows whose key is in the id list."""
    return df.join(ids.select(key), key, "left_semi")


def without_listed(df, ids, key="client_id"):
    """Rows whose key is not in the id list, e.g. of tenants that are done."""
    return df.join(ids.select(key), key, "left_anti")


def maybe_listed(df, ids, by=(), bits=FILTER_BITS):
    """A condition on the rows of ``df``, false only where ``ids`` lacks the key.

    An aggregation hashes the keys of ``ids`` into a bitmap, which the scan of ``df``
    reads as one value of ``bits`` / 8 bytes, however long the list is; the more keys,
    the more rows of other keys pass. Nothing runs before the action.
    """
    keys = [*by, "app_id"]
    listed = ids.select(_place(ids, df, keys, bits).alias("_place")).select(
        F.shiftright("_place", 6).alias("_word"),
        F.expr("shiftleft(1L, CAST(_place & 63 AS INT))").alias("_marks"),
    )
    every = ids.sparkSession.range(bits // 64).select(
        F.col("id").alias("_word"), F.lit(0).cast("bigint").alias("_marks"))
    words = listed.unionByName(every).groupBy("_word").agg(F.bit_or("_marks").alias("_marks"))
    bitmap = words.agg(
        F.sort_array(F.collect_list(F.struct("_word", "_marks")))["_marks"]  # bits / 64 of them
    ).scalar()
    place = _place(df, ids, keys, bits)
    word = F.get(bitmap, F.shiftright(place, 6).cast("int"))
    return F.getbit(word, place.bitwiseAND(F.lit(63)).cast("int")) == 1


def _place(df, other, keys, bits):
    """The bit of a row's keys; keys of different types are compared as text."""
    alike = [
        F.col(key) if df.schema[key].dataType == other.schema[key].dataType else F.col(key).cast("string")
        for key in keys
    ]
    return F.pmod(F.xxhash64(*alike), F.lit(bits))


def prefilter(df, ids, by=(), bits=FILTER_BITS):
    """Drop most rows early whose app_id a later join with ``ids`` drops anyway."""
    return df.filter(maybe_listed(df, ids, by, bits))


def for_listed(df, ids, cheap, costly, by=(), bits=FILTER_BITS):
    """Rows that satisfy both conditions, for a later join with ``ids``.

    The costly condition is evaluated last, for rows that satisfy the cheap one and
    that ``prefilter`` would keep.
    """
    return df.filter(only_if(cheap & maybe_listed(df, ids, by, bits), costly))
