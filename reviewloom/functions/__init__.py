from .categories import bucket_of, date_in_decade, has_genre, year_in_decade
from .parsing import field_count, release_year, strict_long, strict_tinyint, true_flag
from .text import MARKER_WORDS, char_ngrams, marker_hits, marker_language

__all__ = [
    "MARKER_WORDS",
    "bucket_of",
    "char_ngrams",
    "date_in_decade",
    "field_count",
    "has_genre",
    "marker_hits",
    "marker_language",
    "release_year",
    "strict_long",
    "strict_tinyint",
    "true_flag",
    "year_in_decade",
]
