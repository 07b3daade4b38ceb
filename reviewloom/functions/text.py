"""Text features used for language identification."""

from pyspark.sql import functions as F

# Frequent function words that tell the two candidates apart.
MARKER_WORDS = {
    "en": ("the", "and", "of", "to", "is", "that", "with", "for"),
    "es": ("el", "la", "de", "que", "los", "por", "con", "una"),
}


def char_ngrams(text, n):
    """All overlapping n-grams of the lower-cased text, as an array.

    One regular expression pass: look ahead at n code points, step over one.
    """
    text = F.col(text) if isinstance(text, str) else text
    pattern = "(?s)(?=(" + "." * n + "))."
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(1))


def counted(items):
    """The distinct items of an array with their numbers: array of (item, times).

    Equal items are neighbours once the array is sorted, so their numbers are the
    distances between the last ones. Each array made on the way is bound to a name by a
    one-element ``transform``: written out twice, it would be made again for every item.
    """
    def numbered(ordered):
        size = F.size(ordered)
        last = F.filter(F.sequence(F.lit(1), size), lambda i: (i == size) | (
            F.get(ordered, i) != F.get(ordered, i - 1)))
        return F.transform(F.array(last), lambda ends: F.transform(ends, lambda end, at: F.struct(
            F.get(ordered, end - 1).alias("item"),
            (end - F.coalesce(F.get(ends, at - 1), F.lit(0))).alias("times"),
        )))[0]

    return F.when(F.size(items) > 0, F.transform(F.array(F.sort_array(items)), numbered)[0])


def marker_hits(text, words):
    """The marker words among the whitespace-separated words of the text, in order."""
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(text), r"\s+"), lambda word: word.isin(*words))


def best_language(scores):
    """Language with the largest score; ties go to the first name.

    ``scores`` maps a language to a column. NULL when no score is known.
    """
    if len(scores) == 1:
        ((language, score),) = scores.items()
        return F.when(score.isNotNull(), F.lit(language))
    best = F.greatest(*scores.values())
    return F.coalesce(*[
        F.when(scores[language] == best, F.lit(language)) for language in sorted(scores)
    ])


def marker_language(text, markers=None):
    """Language by marker words, ``unknown`` when there is none.

    The text is searched once for the words of all languages; the few hits are
    then counted per language.
    """
    markers = markers or MARKER_WORDS
    hits = marker_hits(text, sorted({word for words in markers.values() for word in words}))
    none = F.struct(*[F.lit(0).alias(language) for language in markers])

    def count(counts, word):
        return F.struct(*[
            (counts[language] + word.isin(*words).cast("int")).alias(language)
            for language, words in markers.items()
        ])

    def name(counts):
        scores = {language: counts[language] for language in markers}
        found = sum(scores.values(), F.lit(0)) > 0
        return F.when(found, best_language(scores)).otherwise("unknown")

    return F.coalesce(F.aggregate(hits, none, count, name), F.lit("unknown"))
