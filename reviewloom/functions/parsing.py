"""Strict typed parsing of CSV text; NULL means "does not parse"."""

from pyspark.sql import functions as F

# The accepted spellings.
INTEGER_TEXT = r"\A[+-]?[0-9]+\z"
DAY_DATE_TEXT = r"\A[A-Za-z]{3} +[0-9]{1,2}, +[0-9]{4}\z"
MONTH_DATE_TEXT = r"\A[A-Za-z]{3} +[0-9]{4}\z"
DAY_DATE_FORMAT = "MMM d, yyyy"
MONTH_DATE_FORMAT = "MMM yyyy"
TRUE_TEXT = "True"


def strict_long(text):
    """An optional sign and digits, nothing else; out of 64 bits is NULL."""
    text = _column(text)
    return F.when(text.rlike(INTEGER_TEXT), text.try_cast("bigint"))


def strict_tinyint(text):
    """As strict_long, limited to -128..127. Out of range does not wrap."""
    return strict_long(text).try_cast("tinyint")


def release_year(text):
    """Year of ``Oct 21, 2008`` or ``May 2020``."""
    text = _column(text)
    spaced = F.regexp_replace(text, " +", " ")
    return F.year(
        F.when(text.rlike(DAY_DATE_TEXT), F.try_to_date(spaced, DAY_DATE_FORMAT))
        .when(text.rlike(MONTH_DATE_TEXT), F.try_to_date(spaced, MONTH_DATE_FORMAT))
    )


def true_flag(text):
    """Exactly ``True``; anything else, also a missing value, is false."""
    return F.coalesce(_column(text) == TRUE_TEXT, F.lit(False))


def field_count(record):
    """Number of comma-separated fields of one raw CSV record."""
    # Possessive, so that long fields need no stack.
    unquoted = F.regexp_replace(_column(record), r'"[^"]*+(?:""[^"]*+)*+"', "")
    return F.length(unquoted) - F.length(F.regexp_replace(unquoted, ",", "")) + 1


def _column(value):
    return F.col(value) if isinstance(value, str) else value
