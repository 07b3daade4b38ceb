"""Language identification as dataflow: fit profiles, classify, evaluate.

A profile holds, per character n-gram, one smoothed log-frequency per candidate
language. The n-grams of a document meet the profile by gram and are summed per
document. With a profile small enough to be broadcast all
grams of a document sit in one task, so the sums are complete before the shuffle: it
moves a few numbers per document, never text.
"""

from pyspark.sql import functions as F

from ..functions import char_ngrams
from ..functions.text import best_language, counted

CANDIDATES = ("en", "es")


def gram_counts(docs, languages=CANDIDATES, n=3, text="text", language="lang"):
    """Occurrences of each n-gram per candidate language: (lang, gram, n)."""
    labelled = docs.filter(F.col(language).isin(*languages))
    grams = labelled.select(
        F.col(language).alias("lang"), F.explode(char_ngrams(text, n)).alias("gram")
    )
    return grams.groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("n"))


def fit_profiles(counts, languages=CANDIDATES):
    """(gram, one weight per language): log((n + 1) / (total + distinct grams)).

    Store the profile before it is used: it is then fitted once.
    """
    wide = counts.groupBy("gram").agg(*[
        F.coalesce(F.sum(F.when(F.col("lang") == name, F.col("n"))), F.lit(0)).alias(name)
        for name in languages
    ])
    totals = wide.agg(F.struct(
        F.count(F.lit(1)).alias("grams"), *[F.sum(name).alias(name) for name in languages]
    ).alias("totals"))
    sized = wide.withColumn("_totals", totals.scalar())
    return sized.select("gram", *[
        F.log(
            (F.col(name) + 1) / (F.col("_totals")[name] + F.col("_totals")["grams"])
        ).alias(name)
        for name in languages
    ])


def classify(docs, profiles, languages=CANDIDATES, n=3, text="text", keys=("doc_id",), count_first=False):
    """(keys, predicted) for every document, ``unknown`` if no gram is known.

    Extra ``keys`` ride along with the document id. Whether the profile is broadcast is
    left to its bytes (store it, so that they are known); a larger one is joined by
    sort-merge, where adaptive execution splits the frequent grams. ``count_first``
    counts the grams of a document inside its row, so that each distinct one is looked up
    once: for long documents and for profiles too large to be broadcast, where every
    looked-up gram is shuffled.
    """
    grams = char_ngrams(text, n)
    if count_first:
        grams = docs.select(*keys, F.explode_outer(counted(grams)).alias("_counted")).select(
            *keys, F.col("_counted.item").alias("_gram"), F.col("_counted.times").alias("_times")
        )
    else:
        grams = docs.select(*keys, F.explode_outer(grams).alias("_gram")).withColumn("_times", F.lit(1))
    known = profiles.select(
        F.xxhash64("gram").alias("_known_hash"), F.col("gram").alias("_known_gram"), *languages
    )
    scores = _weigh(grams, known).groupBy(*keys).agg(*[
        F.sum(F.col(name) * F.col("_times")).alias(name) for name in languages
    ])
    predicted = best_language({name: F.col(name) for name in languages})
    return scores.select(
        *keys, F.coalesce(predicted, F.lit("unknown")).alias("predicted")
    )


def _weigh(grams, known):
    """Add the weights of each gram, NULL for an unknown one.

    Joining on a number is several times faster than on text. The text decides; it
    is compared by order, as an equality would become a join key again.
    """
    same = (
        (F.col("_hash") == F.col("_known_hash"))
        & (F.col("_gram") <= F.col("_known_gram"))
        & (F.col("_gram") >= F.col("_known_gram"))
    )
    return grams.withColumn("_hash", F.xxhash64("_gram")).join(known, same, "left")


def confusion(labelled, gold="lang", predicted="predicted"):
    """Documents per (gold, predicted)."""
    return labelled.groupBy(gold, predicted).agg(F.count(F.lit(1)).alias("n"))
