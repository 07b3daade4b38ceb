"""Row filters and projections. All are narrow: no shuffle, pushed to the scan."""

from pyspark.sql import functions as F

from ..functions import date_in_decade, has_genre, year_in_decade
from ..schema import NEGATIVE, POSITIVE


def by_genre(games, genre, match="exact", genres="genres"):
    return games.filter(has_genre(genres, genre, match))


def by_decade(games, decade, year="release_year", date_text=None):
    """Games of a decade, by year or, where ``date_text`` is named, by date text."""
    if date_text is not None:
        return games.filter(date_in_decade(date_text, decade))
    return games.filter(year_in_decade(year, decade))


def is_polarity(polarity, negative="not_positive", score="score"):
    """Condition for positive or negative reviews.

    Positive means a score of 1. Negative means any other score, or only -1 with
    ``negative='minus_one'``.
    """
    if polarity == "positive":
        return F.col(score) == POSITIVE
    if polarity != "negative":
        raise ValueError(f"unknown polarity: {polarity}")
    if negative == "not_positive":
        return F.col(score) != POSITIVE
    if negative == "minus_one":
        return F.col(score) == NEGATIVE
    raise ValueError(f"unknown negative rule: {negative}")


def by_polarity(reviews, polarity, negative="not_positive", score="score"):
    """Reviews of one polarity."""
    return reviews.filter(is_polarity(polarity, negative, score))


def only_if(cheap, costly):
    """Both conditions hold, and the costly one is evaluated for no other row.

    Two separate conditions would be pushed towards their tables one by one, and a
    costly one on the texts would then run before a join brings in the cheap one.
    """
    return F.when(cheap, costly).otherwise(F.lit(False))


def by_key(df, value, key="app_id"):
    return df.filter(F.col(key) == value)


def over_count(stats, n, stat="stat"):
    """Strictly more than n."""
    return stats.filter(F.col(stat) > n)


def non_empty(stats):
    """Groups with at least one review and a known, non-empty name."""
    return stats.filter((F.col("stat") != 0) & (F.coalesce("name", F.lit("")) != ""))


def playtime_stat(games, by=()):
    return games.select(*by, "app_id", "name", F.col("avg_playtime").alias("stat"))


def complete_rows(df, columns):
    """The named columns of the rows that have a value in each of them."""
    return df.select(*columns).dropna()
