"""Mixing sources to target weights, with DataFrame functions only.

Every row gets a hash-random key. Rows are ranged by that key within their source,
the word counts of the ranges, and of spans of ranges, are summed, and sums over the
spans, ranges and rows before a row give each row its place in its source. No window
holds more than some thousand rows, for a source of up to 10^10 rows. A source is taken
as many whole times as its target holds, and once more up to the exact budget.

Nulls: a null text or size counts as 0 words, a null source is a source of its own
that sorts last, a null id takes the hash of the empty text. Rows that repeat an id
are separate rows. An empty table gives an empty result.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import stored

WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3
ROWS_PER_RANGE = 2_000
RANGES_PER_SPAN = 2_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text):
    """Number of maximal runs of anything but white space; null counts as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes, weights=WEIGHTS, most=MOST_REPEATS):
    """Source, rows, source_size and target from rows of (source, size).

    Sources in order of code points (UTF-8 bytes, null last) weigh ``weights``, over
    and over, and share the sum of all sizes. A target stops at ``most`` times its
    source's size; what is above goes to the others by weight until none is above.
    That point is found directly: in order of (limit / weight), the first sources
    stop at their limits and the rest share what remains. The windows here run over
    one row per source.
    """
    per_source = sizes.groupBy("source").agg(F.count("*").alias("rows"), F.sum("size").alias("source_size"))
    in_order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    weight_of = F.element_at(F.array(*[F.lit(w).cast("bigint") for w in weights]),
                             ((F.row_number().over(in_order) - 1) % len(weights) + 1).cast("int"))
    ranked = per_source.withColumn("weight", weight_of).withColumn("limit", most * F.col("source_size"))
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), F.encode("source", "UTF-8"))
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    after = by_limit.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shared = (
        ranked
        .withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0)))
                    .cast("double") / F.sum("weight").over(after).cast("double"))
        .withColumn("open", F.col("level") * F.col("weight") <= F.col("limit"))
    )
    # the first source below its limit sets the level for itself and all after it
    place = F.struct((F.col("limit") / F.col("weight")).alias("ratio"), F.col("source").isNull().alias("last"),
                     F.encode("source", "UTF-8").alias("name"), "level")
    level = F.min(F.when(F.col("open"), place)).over(everything)["level"]
    share = F.coalesce(level, F.lit(0.0)) * F.col("weight")
    return shared.select(
        "source", "rows", "source_size",
        F.least(F.coalesce(F.when(level.isNotNull(), share), F.col("limit").cast("double")),
                F.col("limit").cast("double")).alias("target"),
    )


def take_words(documents, weights=WEIGHTS, most=MOST_REPEATS, seed="", rows_per_range=ROWS_PER_RANGE,
               ranges_per_span=RANGES_PER_SPAN):
    """The words that the mix takes of every row of (doc_id, source, size).

    Returns doc_id, size, source, source_size, target, taken. A source's taken words
    sum up to its target, rounded down.
    """
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    sizes = stored(documents.select("doc_id", "source", "size", key.alias("key")), "mix-sizes")
    targets = stored(source_targets(sizes, weights, most), "mix-targets")
    ranges = F.ceil(F.col("rows") / rows_per_range)
    place = F.conv(F.substring("key", 1, 8), 16, 10).cast("bigint") / F.lit(1 << 32)
    ranged = (
        sizes.alias("s").join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source")))
        .select("doc_id", "s.source", "size", "key", "source_size", "target",
                F.floor(place * ranges).alias("range"))
    )
    sums = stored(ranged.groupBy("source", "range").agg(F.sum("size").alias("range_size")), "mix-ranges").withColumn(
        "span", F.floor(F.col("range") / ranges_per_span))
    before = Window.partitionBy("source").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = sums.groupBy("source", "span").agg(F.sum("range_size").alias("span_size")).select(
        F.col("source").alias("of"), F.col("span").alias("in_span"),
        F.coalesce(F.sum("span_size").over(before), F.lit(0)).alias("span_start"))
    earlier = Window.partitionBy("source", "span").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        sums.withColumn("in_front", F.coalesce(F.sum("range_size").over(earlier), F.lit(0)))
        .join(spans, F.col("source").eqNullSafe(F.col("of")) & (F.col("span") == F.col("in_span")))
        .select("of", F.col("range").alias("in"), (F.col("span_start") + F.col("in_front")).alias("range_start"))
    )
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, -1)
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    start = F.col("range_start") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    rest = budget - epochs * F.col("source_size") - start
    return (
        ranged.join(starts, F.col("source").eqNullSafe(F.col("of")) & (F.col("range") == F.col("in")))
        .select("doc_id", "size", "source", "source_size", "target",
                (epochs * F.col("size") + F.greatest(F.lit(0), F.least("size", rest))).cast("bigint").alias("taken"))
    )


def _row_names(documents, text):
    """Columns that name a row: its id, or what stands for a missing one, and a digest of all its columns."""
    content = F.concat(F.coalesce(F.length("source").cast("string"), F.lit("")), F.lit(":"),
                       F.coalesce("source", F.lit("")), F.coalesce(F.col(text), F.lit("")))
    # no id has this form, and ids keep the key that take_words gives them
    base = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("no id "), F.md5(content.cast("binary"))))
    rest = F.to_json(F.struct(*[name for name in documents.columns if name != text]))
    whole = F.concat(F.coalesce(F.md5(F.col(text).cast("binary")), F.lit("no text")), rest)
    return base, F.md5(whole.cast("binary"))


def mixed_documents(documents, text="text", copies_per_lot=1_000, **options):
    """The mix itself: every row as often as it is taken whole, and its first words where it is taken in part.

    Keeps the columns of ``documents``; ``n_chars``, if there, is counted anew for a
    row that is cut. The words of a cut row are joined by one space; at most one row
    of a source is cut. Rows that repeat an id are rows of their own: the one with the
    least digest of all columns has the id's place in the mix, the others have places by
    id and digest. Wholly equal rows have one place, by the words of all of them, and
    are copied from one of them in lots of ``copies_per_lot`` where they cannot be taken
    alike. A row without an id goes by its source and text. Rows without words are left out.
    """
    names = documents.columns
    base, digest = _row_names(documents, text)
    distinct = documents.select(
        base.alias("base"), digest.alias("digest"), "source", word_count(F.col(text)).alias("size")
    ).groupBy("base", "digest").agg(F.min("source").alias("source"), F.min("size").alias("size"),
                                    F.count("*").alias("rows"))
    distinct = stored(distinct, "mix-rows")
    # a left join on both columns, as one id may have any number of rows
    leaders = distinct.groupBy("base").agg(F.min("digest").alias("digest")).withColumn("leads", F.lit(True))
    entries = distinct.join(leaders, ["base", "digest"], "left").withColumn(
        "name", F.when(F.col("leads"), F.col("base")).otherwise(F.concat_ws(" ", "base", "digest")))
    taken = take_words(entries.select(F.col("name").alias("doc_id"), "source",
                                      (F.col("size") * F.col("rows")).alias("size")), **options)
    left = F.col("taken") % (F.col("size") * F.col("rows"))
    plan = (
        entries.select("name", "base", "digest", "size", "rows")
        .join(taken.where("taken > 0").select(F.col("doc_id").alias("name"), "taken"), "name")
        .select(F.col("base").alias("of"), F.col("digest").alias("like"), (F.col("rows") > 1).alias("several"),
                F.floor(F.col("taken") / (F.col("size") * F.col("rows"))).alias("each"),
                F.floor(left / F.col("size")).alias("extra"), (left % F.col("size")).alias("part"))
    )
    rows = documents.select(F.struct(*names).alias("row"), base.alias("base"), digest.alias("digest"))
    joined = rows.join(plan, (F.col("base") == F.col("of")) & (F.col("digest") == F.col("like")))
    none = F.array().cast("array<bigint>")
    last = F.when(F.col("part") > 0, F.array("part")).otherwise(none)

    def repeated(times):
        return F.array_repeat(F.lit(0).cast("bigint"), times.cast("int"))

    alike = joined.select("row", F.explode(F.concat(
        repeated(F.col("each")), F.when(F.col("several"), none).otherwise(last))).alias("words"))
    # what equal rows cannot share evenly comes from one of them, the cut row in the first lot
    lot = F.posexplode(F.sequence(F.lit(0).cast("bigint"), F.col("extra"), F.lit(copies_per_lot).cast("bigint")))
    one = joined.where("several").groupBy("of", "like").agg(
        F.first("row").alias("row"), F.first("extra").alias("extra"), F.first("part").alias("part"))
    uneven = one.select("row", "extra", "part", lot.alias("lot", "start")).select("row", F.explode(F.concat(
        repeated(F.least(F.lit(copies_per_lot), F.col("extra") - F.col("start"))),
        F.when(F.col("lot") == 0, last).otherwise(none))).alias("words"))
    copies = alike.unionByName(uneven)
    whole = F.col("row")[text]
    first_words = F.array_join(F.slice(F.filter(F.split(whole, r"[\x20\x09-\x0D]+"), lambda w: w != ""),
                                       F.lit(1), F.greatest(F.lit(1), F.col("words")).cast("int")), " ")
    is_cut = F.col("words") > 0
    changed = {text: F.when(is_cut, first_words).otherwise(whole)}
    if "n_chars" in names:
        kind = documents.schema["n_chars"].dataType
        changed["n_chars"] = F.when(is_cut, F.length(first_words).cast(kind)).otherwise(F.col("row.n_chars"))
    return copies.select([changed.get(name, F.col("row")[name]).alias(name) for name in names])
