"""Predicates over genres, decades and key buckets."""

from pyspark.sql import functions as F


def has_genre(genres, genre, match="exact"):
    """Does the genre array hold ``genre``?

    ``exact`` compares whole, case-sensitive members. ``substring`` searches the
    lower-cased, comma-joined text, so ``Indie Rock`` counts as ``indie``.
    """
    genres = F.col(genres) if isinstance(genres, str) else genres
    if match == "exact":
        return F.array_contains(genres, genre)
    if match == "substring":
        return F.lower(F.array_join(genres, ",")).contains(genre.lower())
    raise ValueError(f"unknown match: {match}")


def year_in_decade(year, decade):
    """The first three digits of the decade occur in the year."""
    year = F.col(year) if isinstance(year, str) else year
    return year.cast("string").contains(str(decade)[:3])


def date_in_decade(date_text, decade):
    """The first three digits of the decade occur anywhere in the date text."""
    date_text = F.col(date_text) if isinstance(date_text, str) else date_text
    return date_text.contains(str(decade)[:3])


def bucket_of(key, buckets):
    """Bucket 1..n of an integer key; the remainder keeps the key's sign."""
    key = F.col(key) if isinstance(key, str) else key
    return (key % buckets + 1).cast("bigint")
