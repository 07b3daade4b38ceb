"""Quality rules: base counts of every text, and a verdict by the ratio of two n-gram models.

Words and pairs of neighbouring words are hashed into a fixed number of buckets. The
buckets' counts over all documents are the raw-corpus multinomial, those over trusted
documents (labelled of good quality and not toxic) the target multinomial. A text's
score is the mean over its words and pairs of log(target / raw); texts that score
below one threshold go. The threshold is where labelled documents that the target was
not fitted on are parted best, so every text is judged alike, and reruns agree.

Only DataFrame functions. A text is judged inside its row; what is shuffled are bucket
counts and slim rows without texts. The weights of the buckets are a broadcast of at
most ``BUCKETS`` rows, trusted ids one of at most ``TRUSTED``.

Definitions: words are runs of anything but white space; a null or empty text has
none, all its counts are 0 and it fails. Windows of 8 words are told apart by 64-bit
hashes within their text. Repeated rows are counted and judged each on their own. A row
with a null id is counted and judged, but never trusted. An id with several labels is
trusted only if all of them agree; labels with nulls are not used. Without trusted
documents every weight is 0 and only the base rules reject; without bad ones the
threshold keeps all but a hundredth of the good ones. An empty table gives an empty
result. Columns other than doc_id and text are not looked at, whatever their names.
"""

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import stored

BUCKETS = 1 << 14
TRUSTED = 50_000
PRIOR = 1 << 13
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30
STEP = 0.001
CLEAN_COUNTS = 5
NO_BAD_LOSS = 0.01
MILLION = 1_000_000
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
WHITE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"


def _shift(array, n):
    """The array from its n-th element (counted from 0) on."""
    return F.slice(array, F.lit(n + 1), F.greatest(F.lit(1), F.size(array)))


def _paired(array, n):
    """Hashes of each element with the one n places on."""
    whole = F.slice(array, F.lit(1), F.greatest(F.lit(0), F.size(array) - n))
    return F.zip_with(whole, _shift(array, n), lambda a, b: F.xxhash64(a, b))


def hashed(documents, text="text"):
    """Add words, and hashes of words (``h1``) and of pairs of them (``h2``)."""
    words = F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), WHITE), "")
    return (
        documents.withColumn("words", words)
        .withColumn("h1", F.transform("words", lambda w: F.xxhash64(w)))
        .withColumn("h2", _paired(F.col("h1"), 1))
    )


def _repeat_words(windows, size):
    """Words under a window that occurs twice or more."""
    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # equal windows are neighbours once sorted
    twice = F.zip_with(
        placed, _shift(placed, 1),
        lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))
    starts = F.array_sort(F.array_distinct(F.flatten(F.filter(twice, lambda x: x.isNotNull()))))
    # up to the next start, at most one window long
    covered = F.zip_with(starts, _shift(starts, 1), lambda a, b: F.coalesce(F.least(b - a, F.lit(size)), F.lit(size)))
    return F.aggregate(covered, F.lit(0), lambda total, n: total + n)


def base_counts(rows, text="text"):
    """Counts of every row of ``hashed``."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return (
        rows
        .withColumn("n_words", F.size("words").cast("bigint"))
        .withColumn("word_chars", F.length(F.array_join("words", "")).cast("bigint"))
        .withColumn("n_symbols", F.regexp_count(body, F.lit(SYMBOLS)).cast("bigint"))
        .withColumn("lines", lines)
        .withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint"))
        .withColumn("windows", _paired(_paired(F.col("h2"), 2), 4))
        .withColumn("n_repeat_words", F.when(
            F.size(F.array_distinct("windows")) == F.size("windows"), F.lit(0)
        ).otherwise(_repeat_words(F.col("windows"), WINDOW)).cast("bigint"))
        .withColumn("base_failed", (F.col("n_words") < LEAST_WORDS)
                    | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))
    )


def _bucket(h, buckets):
    return F.pmod(h, F.lit(buckets))


def judged_ids(labels):
    """(id, clean, bad) of labelled documents: of good quality and not toxic, of bad quality, or neither."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
    return known.groupBy(F.col("doc_id").alias("id")).agg(
        F.bool_and((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("clean"),
        F.bool_and(F.col("quality") == 0).alias("bad"))


def _for_fitting(doc_id):
    """One half of the ids; the threshold is set on the other."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0


def bucket_weights(rows, trusted, buckets=BUCKETS, prior=PRIOR):
    """log(target / raw) of every bucket; ``trusted`` has the ids of the target's documents.

    The target's counts start from ``prior`` counts spread as in the raw corpus, so a
    bucket that the target says little about weighs next to nothing.
    """
    grams = rows.join(F.broadcast(trusted), F.col("doc_id") == F.col("id"), "left").select(
        F.col("id").isNotNull().alias("target"), F.explode(F.concat("h1", "h2")).alias("h"))
    counts = grams.groupBy(_bucket(F.col("h"), buckets).alias("bucket")).agg(
        F.count("*").alias("raw"), F.count_if("target").alias("target"))
    counts = stored(counts, "bucket-counts")
    sums = counts.agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw_share = F.col("raw") / sums.select("raw").scalar()
    total = sums.select("target").scalar()
    weight = F.log((F.col("target") + prior * raw_share) / ((total + prior) * raw_share))
    # whole millionths, so that sums do not depend on their order
    return counts.select("bucket", F.round(weight * MILLION).cast("bigint").alias("weight"))


def scored(rows, weights, names, buckets=BUCKETS):
    """The named columns of every row, and the mean weight of its words and pairs (``score``); 0 where there are none.

    The sums of a row are whole before they leave its task.
    """
    grams = rows.withColumn("row", F.monotonically_increasing_id()).select(
        "row", *names, F.explode_outer(F.concat("h1", "h2")).alias("h")).withColumn(
        "bucket", _bucket(F.col("h"), buckets))
    # at most one row for each of the buckets, whatever the size of the corpus
    met = grams.join(F.broadcast(weights), "bucket", "left")
    mean = F.sum("weight") / F.nullif(F.count("h"), F.lit(0)) / MILLION
    return met.groupBy("row", *names).agg(F.coalesce(mean, F.lit(0.0)).alias("score")).drop("row")


def threshold(scores, judged, step=STEP, clean_counts=CLEAN_COUNTS):
    """The score that parts clean from bad documents best, as a frame of one row.

    Scores are counted in steps. Of all edges between steps the one is taken where the
    share of bad documents below, less ``clean_counts`` times the share of clean ones
    below, is largest; the lowest of equal ones, in the middle of its gap.
    """
    tested = scores.where(~F.col("base_failed")).join(judged, F.col("doc_id") == F.col("id"))
    bins = tested.groupBy(F.floor(F.col("score") / step).alias("bin")).agg(
        F.count_if("clean").alias("clean"), F.count_if("bad").alias("bad")).where("clean + bad > 0")
    # some ten thousand bins at most: weights are bounded by the logarithm of the counts
    below = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def share(name):
        return F.coalesce(F.sum(name).over(below), F.lit(0)) / F.nullif(F.sum(name).over(whole), F.lit(0))

    edges = bins.select(
        "bin", F.lag("bin").over(Window.orderBy("bin")).alias("before"),
        share("clean").alias("clean_lost"), share("bad").alias("bad_caught"))
    lost = F.coalesce("clean_lost", F.lit(0.0))
    gain = F.coalesce(F.col("bad_caught") - clean_counts * lost, -F.abs(lost - NO_BAD_LOSS))
    middle = (F.col("bin") + F.coalesce(F.col("before") + 1, F.col("bin"))) / 2 * step
    best = edges.agg(F.max(F.struct(gain.alias("gain"), (-F.col("bin")).alias("bin"), middle.alias("edge"))).alias("best"))
    return best.select(F.coalesce("best.edge", F.lit(-math.inf)).alias("edge"))


def quality_rules(documents, labels, buckets=BUCKETS, trusted=TRUSTED, prior=PRIOR):
    """Base counts, score and verdict of every row of (doc_id, text).

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, score, kept. ``labels`` has doc_id, quality, toxic. The target is
    fitted on at most ``trusted`` clean documents, drawn by a hash of the id.
    """
    rows = hashed(documents.select("doc_id", "text"))
    judged = judged_ids(labels)
    chosen = judged.where(F.col("clean") & _for_fitting(F.col("id"))).select("id").orderBy(
        F.xxhash64("id"), "id").limit(trusted)
    weights = bucket_weights(rows, stored(chosen, "trusted-ids"), buckets, prior)
    scores = stored(scored(base_counts(rows), weights, ["doc_id", *COUNTS], buckets), "quality-scores")
    edge = threshold(scores, judged.where(~_for_fitting(F.col("id")))).scalar()
    return scores.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= edge))
