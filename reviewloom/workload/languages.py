"""Language identification over the documents table."""

from pyspark.sql import functions as F

from .. import operators as op
from .. import plans
from ..functions import marker_language
from ..session import stored
from ..sources import as_result
from .questions import predicted_sql
from .registry import query
from .tables import TEXT_GAMES_SQL, TEXT_REVIEWS_SQL, text_games, text_reviews, texts

MARKER_SQL = f"SELECT doc_id, lang, {predicted_sql()} AS predicted FROM documents"

GRAMS_SQL = """
chars AS (SELECT doc_id, lang, string_split(lower(text), '') AS c FROM documents),
doc_grams AS (
  SELECT doc_id, lang,
         unnest(list_transform(range(1, len(c) - 1),
                               lambda i: c[i] || c[i + 1] || c[i + 2])) AS gram
  FROM chars),
counts AS (
  SELECT lang, gram, count(*) AS n FROM doc_grams WHERE lang IN ('en', 'es') GROUP BY lang, gram)"""

CLASSIFIED_SQL = f"""{GRAMS_SQL},
wide AS (
  SELECT gram, coalesce(sum(n) FILTER (lang = 'en'), 0) AS en,
         coalesce(sum(n) FILTER (lang = 'es'), 0) AS es
  FROM counts GROUP BY gram),
profiles AS (
  SELECT gram, ln((en + 1)::DOUBLE / (sum(en) OVER () + count(*) OVER ())) AS en,
         ln((es + 1)::DOUBLE / (sum(es) OVER () + count(*) OVER ())) AS es
  FROM wide),
scores AS (
  SELECT doc_id, sum(en) AS en, sum(es) AS es FROM doc_grams JOIN profiles USING (gram)
  GROUP BY doc_id),
classified AS (
  SELECT doc_id, lang, CASE WHEN scores.doc_id IS NULL THEN 'unknown'
         WHEN en >= es THEN 'en' ELSE 'es' END AS predicted
  FROM documents LEFT JOIN scores USING (doc_id))"""


def stored_profiles(spark, sf_dir):
    """Profiles fitted on the labelled documents, as a table."""
    counts = stored(op.gram_counts(texts(spark, sf_dir)), "gram-counts")
    return stored(op.fit_profiles(counts), "profiles")


def _marked(spark, sf_dir):
    return texts(spark, sf_dir).select(
        "doc_id", "lang", marker_language("text").alias("predicted")
    )


def _classified(spark, sf_dir):
    return op.classify(
        texts(spark, sf_dir), stored_profiles(spark, sf_dir), keys=("doc_id", "lang")
    )


@query("lang_marker", MARKER_SQL)
def lang_marker(spark, sf_dir):
    return _marked(spark, sf_dir)


@query("lang_profile", f"WITH {GRAMS_SQL} SELECT lang, gram, n FROM counts")
def lang_profile(spark, sf_dir):
    return op.gram_counts(texts(spark, sf_dir))


@query("lang_classify", f"WITH {CLASSIFIED_SQL} SELECT doc_id, lang, predicted FROM classified")
def lang_classify(spark, sf_dir):
    return _classified(spark, sf_dir)


@query("lang_confusion", f"""WITH {CLASSIFIED_SQL}
SELECT lang, predicted, count(*) AS n FROM classified GROUP BY lang, predicted""")
def lang_confusion(spark, sf_dir):
    return op.confusion(_classified(spark, sf_dir))


@query("lang_agreement", f"""WITH {CLASSIFIED_SQL}, marked AS ({MARKER_SQL})
SELECT m.predicted AS predicted_a, c.predicted AS predicted_b, count(*) AS n
FROM marked m FULL JOIN classified c USING (doc_id) GROUP BY ALL""")
def lang_agreement(spark, sf_dir):
    pairs = op.paired(_marked(spark, sf_dir), _classified(spark, sf_dir), "doc_id", "predicted")
    return op.agreement(pairs, "predicted_a", "predicted_b")


@query("over_threshold_profile", f"""
WITH {TEXT_GAMES_SQL}, {TEXT_REVIEWS_SQL}, {CLASSIFIED_SQL}
SELECT app_id AS "AppID", name AS "Name", count(*) AS "Reviews"
FROM games JOIN reviews USING (app_id) JOIN classified USING (doc_id)
WHERE list_contains(genres, 'es') AND score <> 1 AND predicted = 'en'
GROUP BY app_id, name HAVING count(*) > 2""")
def over_threshold_profile(spark, sf_dir):
    """Question 4 with the fitted detector, asked only about reviews that may count."""
    games = text_games(spark, sf_dir)
    negative = op.by_polarity(text_reviews(spark, sf_dir), "negative")
    asked = op.prefilter(negative, op.by_genre(games, "es"))
    classified = op.classify(
        asked, stored_profiles(spark, sf_dir), keys=("doc_id", "app_id", "score")
    )
    answer = plans.over_threshold(games, classified, "es", 2, F.col("predicted") == "en")
    return as_result(answer, 4)
