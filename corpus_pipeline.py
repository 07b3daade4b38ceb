"""A corpus pipeline: language, near-duplicates, repeated passages, source mix, packing.

``run`` applies the stages to ``documents``; each stage's rows are written to the
shared folder and read again by the next one.
"""

from pyspark.sql import functions as F

from reviewloom.llm import languages, mixing, packing, passages, sketches
from reviewloom.session import discard, stored


def language_id(spark, docs, sf_dir):
    """Keep the documents whose language can be told."""
    labelled = languages.predict(docs, languages.fit(docs))
    return labelled.where(F.col("lang_pred") != languages.UNKNOWN).select(docs.columns)


def near_duplicates(spark, docs, sf_dir):
    """Keep one document of each group of near-duplicates, and documents without an id."""
    gone = sketches.near_documents(docs).where(~F.col("kept")).select(F.col("doc_id").alias("of")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    return rows.join(gone, F.col("row.doc_id") == F.col("of"), "left_anti").select("row.*")


def repeated_passages(spark, docs, sf_dir):
    """Remove passages that an earlier document has as well."""
    found = passages.repeated_passages(docs)
    kept = stored(found, "passages")
    discard(*found.made_from)
    return passages.without_passages(docs, kept)


def source_mix(spark, docs, sf_dir):
    """Each source as often as its target weight asks for."""
    return mixing.mixed_documents(docs)


def best_fit_packing(spark, docs, sf_dir):
    """A place in a sequence of 1024 tokens for every piece of every document."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("best_fit_packing", best_fit_packing),
]

#: Tokens and fitted models are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
