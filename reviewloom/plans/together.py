"""All five questions about one dataset, with one scan of the reviews."""

from pyspark.sql import functions as F

from ..operators import (
    by_genre,
    count_flags,
    is_polarity,
    named_counts,
    only_if,
    over_count,
    percentile_cut,
    prefilter,
    top_n,
)
from ..session import stored
from ..sources import as_result, write_result
from .questions import platform_counts, top_playtime


def all_answers(
    games, reviews, in_language, top_genre="Indie", bad_genre="Action", decade=2010,
    longest=10, best=5, more_than=5000, p=90, ties="cut", method="nearest",
    match="exact", negative="not_positive", names="last", seq=None,
):
    """{question number: answer} for the five questions.

    The positive reviews, the negative ones and those of them in the language are
    counted per game in one pass, and stored: one row per game. Texts are examined
    only for negative reviews.
    """
    best_games = by_genre(games, top_genre, match)
    bad_games = by_genre(games, bad_genre, match)
    asked = prefilter(reviews, best_games.select("app_id").union(bad_games.select("app_id")))
    is_negative = is_polarity("negative", negative)
    counts = stored(count_flags(asked, {
        "positive": is_polarity("positive"),
        "negative": is_negative,
        "in_language": only_if(is_negative, in_language),
    }, by=("app_id",)), "review-counts")

    def counted(chosen, which):
        stats = counts.select("app_id", F.col(which).alias("stat")).filter(F.col("stat") > 0)
        return named_counts(chosen, stats, names, seq)

    negatives = stored(counted(bad_games, "negative"), "negative-counts")
    return {
        1: platform_counts(games),
        2: top_playtime(games, top_genre, decade, longest, match),
        3: top_n(counted(best_games, "positive"), best),
        4: over_count(counted(bad_games, "in_language"), more_than).orderBy("app_id"),
        5: percentile_cut(negatives, p, method=method, ties=ties).orderBy("stat", "app_id"),
    }


def write_answers(answers, path, fmt="csv"):
    """Write every answer under its number, with its result header."""
    for number, answer in answers.items():
        write_result(as_result(answer, number), path, number, fmt)
