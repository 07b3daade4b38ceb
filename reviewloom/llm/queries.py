"""The operators of this folder, each applied to its whole table."""

from pyspark.sql import functions as F

from . import (
    attribution,
    conversations,
    languages,
    mixing,
    negatives,
    neighbours,
    packing,
    pages,
    passages,
    quality,
    retrieval,
    sketches,
    suffixes,
)

QUERIES = {}
SQL = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_main_text(spark, sf_dir):
    """The main text of every page."""
    return pages.main_texts(table(spark, sf_dir, "pages"))


def held_out(doc_id):
    """The third of the documents that no language model learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


@query
def op2_language_id(spark, sf_dir):
    """The language of every document, learned from two thirds of them."""
    documents = table(spark, sf_dir, "documents")
    model = languages.fit(documents.where(~held_out(F.col("doc_id"))))
    return languages.predict(
        documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model).drop("text")


@query
def op3_token_counts(spark, sf_dir):
    """Tokens of every line of every document."""
    return attribution.attributed_tokens(table(spark, sf_dir, "documents")).drop("name")


@query
def op4_best_fit_packing(spark, sf_dir):
    """A place in a sequence of 1024 tokens for every piece of every document."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query
def op5_near_vectors(spark, sf_dir):
    """Links and components of all vectors of equal label with a cosine of 0.98 or more."""
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))
    return neighbours.near_vectors(vectors).withColumnRenamed("id", "vec_id")


@query
def op6_repeated_bytes(spark, sf_dir):
    """What every document keeps without the strings of 400 bytes that also start elsewhere."""
    return suffixes.without_repeats(table(spark, sf_dir, "documents")).drop("spans")


@query
def op7_near_documents(spark, sf_dir):
    """Near-duplicate groups of all documents, by shingles of 3 words and a similarity of 0.85."""
    return sketches.near_documents(table(spark, sf_dir, "documents"), n_words=3, similarity=(85, 100))


@query
def op8_top_products(spark, sf_dir):
    """The 5 highest inner products of every 50th vector with all others, in whole units of 1/256."""
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    whole = retrieval.integer_vectors(vectors)
    return retrieval.top_k(whole, whole.where(F.col("id") % 50 == 0))


@query
def op9_repeated_passages(spark, sf_dir):
    """Passages of 50 words or more that an earlier document has as well."""
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


@query
def op10_source_mix(spark, sf_dir):
    """Words that a mix of all sources takes of every document."""
    documents = table(spark, sf_dir, "documents")
    sizes = documents.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    return mixing.take_words(sizes)


@query
def op11_hard_negatives(spark, sf_dir):
    """Rows of other labels that come close to the positives of every 100th vector."""
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"),
        F.col("embedding").alias("vector"))
    whole = negatives.integer_rows(vectors)
    return negatives.hard_negatives(whole, whole.where(F.col("id") % 100 == 0))


@query
def op12_conversation_trie(spark, sf_dir):
    """Every prefix that rebuilt conversations have, with what sharing it saves."""
    turns = conversations.turn_sequences(table(spark, sf_dir, "conversations"))
    return conversations.prefix_trie(conversations.rebuilt(turns)).drop("key")


@query
def op13_quality_rules(spark, sf_dir):
    """Base counts and a verdict for every document."""
    return quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL["op10_source_mix"] = r"""
WITH RECURSIVE sized AS (
    SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key,
           CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
    FROM documents
), per_source AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
           CAST((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1 AS BIGINT) AS weight
    FROM sized GROUP BY source
), rounds AS (
    SELECT 0 AS round, source, source_size, weight, false AS full_up,
           CAST((SELECT sum(source_size) FROM per_source) AS BIGINT) AS rest,
           CAST((SELECT sum(weight) FROM per_source) AS BIGINT) AS weights
    FROM per_source
    UNION ALL
    SELECT round + 1, source, source_size, weight, now_full,
           CAST(rest - coalesce(sum(CASE WHEN now_full AND NOT full_up THEN 3 * source_size END) OVER (), 0) AS BIGINT),
           CAST(weights - coalesce(sum(CASE WHEN now_full AND NOT full_up THEN weight END) OVER (), 0) AS BIGINT)
    FROM (SELECT *, full_up OR CAST(rest AS DOUBLE) / weights * weight > 3 * source_size AS now_full FROM rounds)
    WHERE round < 60 AND weights > 0
), targets AS (
    SELECT source, source_size,
           CASE WHEN full_up THEN CAST(3 * source_size AS DOUBLE)
                ELSE CAST(rest AS DOUBLE) / weights * weight END AS target
    FROM rounds QUALIFY round = max(round) OVER (PARTITION BY source)
), placed AS (
    SELECT s.doc_id, s.size, s.source, t.source_size, t.target,
           CAST(coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
    FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), epochs AS (
    SELECT *, CAST(floor(target) AS BIGINT) AS budget,
           CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS whole
    FROM placed
)
SELECT doc_id, size, source, source_size, target,
       CAST(whole * size + greatest(0, least(size, budget - whole * source_size - before)) AS BIGINT) AS taken
FROM epochs
"""

SQL["op5_near_vectors"] = """
WITH RECURSIVE usable AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0 AND label IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), reach AS (
    SELECT vec_id, vec_id AS seen FROM embeddings
    UNION
    SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.seen
), least AS (
    SELECT vec_id, min(seen) AS component_id FROM reach GROUP BY vec_id
), counts AS (
    SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a
)
SELECT e.vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN least USING (vec_id) LEFT JOIN counts USING (vec_id)
"""

SQL["op8_top_products"] = """
WITH whole AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
    FROM whole q JOIN whole c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id, score
FROM scored QUALIFY rank <= 5
"""

SQL["op7_near_documents"] = r"""
WITH RECURSIVE worded AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []
           WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
           ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS s
    FROM worded
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
    JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
    GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
), reach AS (
    SELECT doc_id, doc_id AS seen FROM documents
    UNION
    SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.seen
), least AS (
    SELECT doc_id, min(seen) AS component_id FROM reach GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN least USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""

SQL["op11_hard_negatives"] = """
WITH whole AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
           CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score
    FROM whole a JOIN whole c ON a.vec_id <> c.vec_id AND len(a.v) = len(c.v) WHERE a.vec_id % 100 = 0
), positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT same
WHERE 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
"""

SQL["op12_conversation_trie"] = r"""
WITH crc_table AS (
    SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)
                ORDER BY i) AS t
    FROM (SELECT CAST(range AS BIGINT) AS i FROM range(256))
), turns AS (
    SELECT CAST(conv_id AS BIGINT) AS conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
               sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
    FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
    SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(
        list_transform(range(1, len(CAST(conv_id AS VARCHAR)) + 1),
                       lambda i: CAST(ascii(substr(CAST(conv_id AS VARCHAR), i, 1)) AS BIGINT)),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 4 AS h
    FROM (SELECT DISTINCT conv_id FROM turns), crc_table
), chosen AS (
    SELECT c.conv_id, 0 AS part, pos, role, text FROM convs c JOIN turns t ON t.conv_id = c.base AND pos <= h
    UNION ALL
    SELECT c.conv_id, 1, pos, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND pos > h
), prefixes AS (
    SELECT conv_id, row_number() OVER path AS depth,
           list({'role': role, 'text': text}) OVER (path ROWS UNBOUNDED PRECEDING) AS prefix,
           len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words
    FROM chosen WINDOW path AS (PARTITION BY conv_id ORDER BY part, pos)
    UNION ALL
    SELECT conv_id, 0, [], 0 FROM convs
), members AS (
    SELECT conv_id AS member, depth, words, min(conv_id) OVER (PARTITION BY depth, prefix) AS conv_id,
           depth = max(depth) OVER (PARTITION BY conv_id) AS ends
    FROM prefixes
), nodes AS (
    SELECT conv_id, depth, min(words) AS words, count(*) AS n_convs,
           string_agg(CAST(member AS VARCHAR), ',' ORDER BY member) FILTER (WHERE ends) AS ended
    FROM members GROUP BY conv_id, depth
), linked AS (
    SELECT n.*, m.conv_id AS parent_conv_id
    FROM nodes n LEFT JOIN members m ON m.member = n.conv_id AND m.depth = n.depth - 1
), children AS (
    SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM linked WHERE depth > 0
    GROUP BY ALL
), counted AS (
    SELECT l.*, coalesce(n_children, 0) AS n_children FROM linked l LEFT JOIN children USING (conv_id, depth)
), subtrees AS (
    SELECT m.conv_id, m.depth, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * c.words) AS saved
    FROM counted c JOIN members m ON m.member = c.conv_id AND m.depth <= c.depth GROUP BY m.conv_id, m.depth
)
SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, n_convs, n_children, n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ended, '')) AS ends_sha256
FROM counted JOIN subtrees USING (conv_id, depth)
"""
