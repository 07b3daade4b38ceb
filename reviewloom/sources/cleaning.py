"""Typed rows and a quarantine out of raw text fields.

``judge_*`` keeps every input row: ``row`` holds the typed record, ``source`` the
fields as read and ``reason`` why the row is rejected (NULL for a good one). The
first rule a row breaks gives the reason. Only the empty string counts as
missing; ``NA`` and ``null`` are ordinary text.
"""

from pyspark.sql import functions as F

from ..functions import release_year, strict_long, strict_tinyint, true_flag
from ..operators.aggregates import observed_counts, watched
from ..schema import GAME_WIDTH, REVIEW_WIDTH

GAME_REASONS = ("width", "bad app_id", "bad release date", "bad playtime", "empty name", "empty genres")
REVIEW_REASONS = ("width", "bad app_id", "bad score", "empty text")


def judge_games(raw):
    app_id = strict_long("app_id")
    year = release_year("release_date")
    playtime = strict_long("avg_playtime")
    reason = (
        F.when(F.col("n_fields") < GAME_WIDTH, "width")
        .when(app_id.isNull(), "bad app_id")
        .when(year.isNull(), "bad release date")
        .when(playtime.isNull(), "bad playtime")
        .when(_empty("name"), "empty name")
        .when(_empty("genres"), "empty genres")
    )
    row = F.struct(
        app_id.alias("app_id"),
        F.col("name"),
        year.alias("release_year"),
        *[true_flag(flag).alias(flag) for flag in ("windows", "mac", "linux")],
        playtime.alias("avg_playtime"),
        F.split("genres", ",").alias("genres"),
    )
    return _judged(raw, row, reason)


def judge_reviews(raw):
    app_id = strict_long("app_id")
    score = strict_tinyint("score")
    reason = (
        F.when(F.col("n_fields") < REVIEW_WIDTH, "width")
        .when(app_id.isNull(), "bad app_id")
        .when(score.isNull(), "bad score")
        .when(_empty("text"), "empty text")
    )
    row = F.struct(app_id.alias("app_id"), F.col("text"), score.alias("score"))
    return _judged(raw, row, reason)


def clean_games(raw):
    """(clean, quarantine) frames."""
    return _split(judge_games(raw))


def clean_reviews(raw):
    """(clean, quarantine) frames."""
    return _split(judge_reviews(raw))


def reason_counts(judged):
    """Rows per reject reason; the good ones are counted as ``accepted``."""
    return judged.groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(
        F.count(F.lit(1)).alias("n")
    )


def write_judged(judged, path, reasons=(*GAME_REASONS, *REVIEW_REASONS)):
    """Write clean rows and quarantine in one job: (clean, quarantine, counts per reason).

    The folder has a part per ``accepted``, so each of the two frames reads its own. The
    counts are seen by that job on its way, as in ``reason_counts``.
    """
    spark = judged.sparkSession
    good = F.col("reason").isNull()
    stages = {"accepted": good} | {reason: F.col("reason") == reason for reason in reasons}
    rows, seen = watched(judged, stages)
    rows.select(
        good.alias("accepted"), "reason", F.when(good, F.col("row")).alias("row"),
        F.when(~good, F.col("source")).alias("source"),
    ).write.mode("overwrite").partitionBy("accepted").parquet(path)
    fields = judged.select("reason", "row", "source").schema.add("accepted", "boolean")
    written = spark.read.schema(fields).parquet(path)
    counts = observed_counts(spark, seen, "reason").filter(F.col("n") > 0)
    clean = written.filter(F.col("accepted")).select("row.*")
    return clean, written.filter(~F.col("accepted")).select("reason", "source.*"), counts


def _judged(raw, row, reason):
    return raw.select(row.alias("row"), reason.alias("reason"), F.struct("*").alias("source"))


def _split(judged):
    clean = judged.filter(F.col("reason").isNull()).select("row.*")
    quarantine = judged.filter(F.col("reason").isNotNull()).select("reason", "source.*")
    return clean, quarantine


def _empty(name):
    return F.coalesce(F.col(name), F.lit("")) == ""
