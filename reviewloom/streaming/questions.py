"""The five questions over streams of catalogue rows and reviews of many tenants.

The streams carry ``client_id``; the catalogue also ``seq``, which orders the rows
of a game. Either stream may be ahead of the other. Each function processes what
is there, keeps its state in ``folder`` and returns the answer so far; once the
streams are complete (see ``ledger``) it is the answer of the batch question.

With a processing-time trigger, ``every="10 seconds"``, the question is left running:
the function returns a ``Running`` query, whose ``answer()`` may be read at any time.
Stopped and asked again with the same folder, it goes on where it was.
"""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import (
    by_decade,
    by_genre,
    by_polarity,
    non_empty,
    playtime_stat,
)
from ..plans.questions import PLATFORMS
from .epochs import answered, latest, run_epochs, start_log, written_view
from .keyed import keyed_counts, run_histograms, run_percentile, run_top, running_flags
from .results import progress

TENANT = ("client_id",)


def tagged_rows(games, reviews):
    """Catalogue rows and reviews as one stream for ``keyed_counts``."""
    named = games.select("client_id", "app_id", "name", "seq", F.lit(False).alias("is_review"))
    counted = reviews.select("client_id", "app_id", F.lit(True).alias("is_review"))
    return named.unionByName(counted, allowMissingColumns=True)


def stream_platform_counts(games, folder, **options):
    flags = {name: F.col(flag) for name, flag in PLATFORMS.items()}
    fields = [T.StructField(name, T.LongType()) for name in ("client_id", *flags)]
    schema = T.StructType(fields)
    start_log(games.sparkSession, f"{folder}/log", schema)
    query = run_epochs(
        running_flags(games, flags), lambda rows, epoch: rows,
        f"{folder}/log", f"{folder}/checkpoint", "update", keys=list(TENANT), **options,
    )
    return answered(query, lambda: latest(
        written_view(games.sparkSession, f"{folder}/log", schema), TENANT, list(flags)))


def stream_top_playtime(games, folder, genre="Indie", decade=2010, n=10, match="exact", **options):
    chosen = by_decade(by_genre(games, genre, match), decade)
    stats = playtime_stat(chosen, TENANT)
    return run_top(stats, n, f"{folder}/log", f"{folder}/checkpoint", growing=False, **options)


def stream_top_reviewed(
    games, reviews, folder, genre="Indie", polarity="positive", n=5,
    match="exact", negative="not_positive", **options,
):
    counts = _counts(games, reviews, genre, polarity, match, negative)
    return run_top(counts, n, f"{folder}/log", f"{folder}/checkpoint", **options)


def stream_over_threshold(
    games, reviews, folder, genre="Action", n=5000, in_language=None,
    match="exact", negative="not_positive", **options,
):
    counts = _counts(games, reviews, genre, "negative", match, negative, in_language)
    return progress(counts, n, f"{folder}/log", f"{folder}/checkpoint", **options)


def stream_percentile_question(
    games, reviews, folder, genre="Action", p=90,
    match="exact", negative="not_positive", complete=None, **options,
):
    """``complete``: the tenants to answer for, those whose streams have ended."""
    counts = _counts(games, reviews, genre, "negative", match, negative)
    return run_percentile(counts, p, f"{folder}/log", f"{folder}/checkpoint", complete, **options)


def stream_percentile_ranks(
    games, reviews, folder, genre="Action", p=90, match="exact", negative="not_positive",
    lanes=8, control=None, **options,
):
    """``stream_percentile_question`` with ranks that are kept up to date (see ``run_histograms``)."""
    wanted = by_polarity(reviews, "negative", negative)
    rows = tagged_rows(by_genre(games, genre, match), wanted)
    return run_histograms(rows, folder, lanes, control, p, **options)


def _counts(games, reviews, genre, polarity, match, negative, condition=None):
    wanted = by_polarity(reviews, polarity, negative)
    if condition is not None:
        wanted = wanted.filter(condition)
    return non_empty(keyed_counts(tagged_rows(by_genre(games, genre, match), wanted)))
