"""The corpus pipeline: stages hand on documents, decisions take effect, edge cases."""

import random

import corpus_pipeline as pipeline
from reviewloom.llm import mixing

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def made(r):
    def words(n):
        return [f"{r.choice(('the', 'and', 'chat', 'word'))}{r.choice('abcdefgh')}{r.randint(0, 10 ** 6)}"
                for _ in range(n)]

    passage = words(70)
    rows = [(i, " ".join(words(100)), "en", f"s{i % 3}", 0) for i in range(40)]
    rows += [(100 + i, rows[i][1] + " end", "en", "s0", 0) for i in range(5)]            # near copies
    rows += [(200 + i, " ".join(words(40) + passage + words(40)), "en", "s1", 0) for i in range(4)]
    rows += [(300, None, "en", "s2", 0), (301, "12 34 !", None, None, None), (302, "", "fr", "s2", 0)]
    return [(i, t, lang, s, len(t or "")) for i, t, lang, s, _ in rows], " ".join(passage)


def test_stages(spark):
    rows, passage = made(random.Random(1))
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = {}
    for name, stage in pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, None).collect(), SCHEMA)
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert docs.columns == SCHEMA.replace(" bigint", "").replace(" string", "").split(", ")
    good = set(range(40)) | set(range(200, 204))
    assert set(kept["language_id"]) == good | set(range(100, 105))
    assert set(kept["near_duplicates"]) == good
    with_passage = [i for i, t in kept["repeated_passages"].items() if passage in t]
    assert set(kept["repeated_passages"]) == good and with_passage == [200]
    texts = kept["repeated_passages"]
    assert all(texts[i] == dict((r[0], r[1]) for r in rows)[i] for i in range(40))
    placed = pipeline.best_fit_packing(spark, docs, None).collect()
    assert {r["doc_id"] for r in placed} == set(kept["source_mix"])


def test_empty_and_repeated(spark):
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, None).count() == 0
    twice = spark.createDataFrame([(1, "some words here", "en", "a", 15)] * 2 + [(None, "more", "en", None, 4)], SCHEMA)
    docs = twice
    for _, stage in pipeline.STAGES[:3]:
        docs = spark.createDataFrame(stage(spark, docs, None).collect(), SCHEMA)
    assert sorted(str(r["doc_id"]) for r in docs.collect()) == ["1", "1", "None"]


def test_whole_table(spark):
    """Brute force of the mix: every document that is placed was taken, as often as the mix says."""
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in pipeline.STAGES[:3]:
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), docs.schema)
    sizes = docs.select("doc_id", "source", mixing.word_count(docs["text"]).alias("size"))
    taken = {r["doc_id"]: -(-r["taken"] // r["size"]) for r in mixing.take_words(sizes).collect() if r["taken"]}
    placed = {}
    for r in pipeline.run(spark, sf_dir).collect():
        if r["piece"] == 0:
            placed[r["doc_id"]] = placed.get(r["doc_id"], 0) + 1
    assert placed == taken
