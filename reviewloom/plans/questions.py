"""The five questions. Every constant is a parameter.

Options select between two readings of the edge cases:

* ``match``     genre as an exact array member, or as a substring
* ``negative``  every score but 1, or only -1
* ``names``     repeated app_ids are one game, or multiply its reviews
* ``ties``, ``method``  how the percentile is cut

With ``by=("client_id",)`` a question is answered for every tenant at once, each
from its own catalogue and reviews.
"""

from pyspark.sql import functions as F

from ..operators import (
    by_decade,
    by_genre,
    by_polarity,
    count_flags,
    for_listed,
    game_review_counts,
    is_polarity,
    over_count,
    percentile_cut,
    playtime_stat,
    top_n,
)
from ..session import stored

PLATFORMS = {"Linux": "linux", "Mac": "mac", "Windows": "windows"}


def platform_counts(games, by=()):
    """1: how many games support Linux, Mac and Windows."""
    return count_flags(games, {name: F.col(flag) for name, flag in PLATFORMS.items()}, by)


def top_playtime(
    games, genre="Indie", decade=2010, n=10, match="exact", date_text=None, by=()
):
    """2: the games of a genre and decade with the longest average playtime."""
    chosen = by_decade(by_genre(games, genre, match), decade, date_text=date_text)
    return top_n(playtime_stat(chosen, by), n, by)


def top_reviewed(
    games, reviews, genre="Indie", polarity="positive", n=5,
    match="exact", negative="not_positive", names="last", seq=None, by=(),
):
    """3: the games of a genre with the most positive reviews."""
    chosen = by_genre(games, genre, match)
    wanted = by_polarity(reviews, polarity, negative)
    return top_n(game_review_counts(chosen, wanted, names, seq, by), n, by)


def over_threshold(
    games, reviews, genre="Action", n=5000, in_language=None,
    match="exact", negative="not_positive", names="last", seq=None, by=(),
):
    """4: games with more than n negative reviews in a language.

    ``in_language`` is a condition on the reviews. It is applied after the score and
    the genre, so the texts of other reviews are never examined.
    """
    chosen = by_genre(games, genre, match)
    if in_language is None:
        wanted = by_polarity(reviews, "negative", negative)
    else:
        wanted = for_listed(reviews, chosen, is_polarity("negative", negative), in_language, by)
    counts = game_review_counts(chosen, wanted, names, seq, by)
    return over_count(counts, n).orderBy(*by, "app_id")


def percentile_question(
    games, reviews, genre="Action", p=90, method="nearest", ties="cut",
    match="exact", negative="not_positive", names="last", seq=None, by=(),
):
    """5: games at or above a percentile of the number of negative reviews.

    The counts are read several times to find the cut, so they are stored first:
    one row per game, and the reviews are scanned once.
    """
    chosen = by_genre(games, genre, match)
    wanted = by_polarity(reviews, "negative", negative)
    counts = stored(game_review_counts(chosen, wanted, names, seq, by), "negative-counts")
    return percentile_cut(counts, p, by, method, ties).orderBy(*by, "stat", "app_id")
