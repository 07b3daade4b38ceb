"""Exact top-k search by inner product over integer vectors, in buckets of similar length.

Vectors are sorted by length and cut into blocks of a fixed number of rows, longest
first; a block is a few buckets. Every query first searches the longest vectors of
all, which gives it a score that its answers must reach. With that score each bucket
has a cosine that its vectors must reach, at their greatest length:

* above 1 the bucket is left out (length pruning),
* otherwise a product over the query's largest coordinates, plus the lengths of the
  rest, bounds every vector's score from above (coordinate pruning); where the cosine
  asked for is so low that nothing would be pruned, this step is left out,
* what remains is verified with whole products.

The blocks of queries that a block of vectors may answer, by its greatest length, are
listed first, without the vectors; a list entry then fetches its two blocks by their
numbers. A task holds two blocks at a time, whatever the size of either side.

Null vectors and vectors with null or non-finite components take no part, neither
do those without components. Scores are defined between vectors of equal dimension.
Equal scores go to the smaller id. Query ids must be unique, so the query set is
reduced to one row (the smallest vector) per id; other rows that repeat an id are rows
of their own, and a query skips all rows with its own id. Empty tables give an empty result. Components
must be small enough for scores to be 64-bit integers.
"""

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import stored

K = 5
BLOCK_ROWS = 4096
BUCKET_ROWS = 512
QUERY_ROWS = 1024
FOCUS = 16
LANES = 16
BLOCKS = "dim int, block bigint, n int, longest double, ids binary, vectors binary"
EXACT = float(1 << 52)


def integer_vectors(vectors, scale=256):
    """(id, v) with v = floor(scale * x) for every finite vector of (id, vector)."""
    usable = (F.col("vector").isNotNull() & (F.size("vector") > 0)
              & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x.cast("double"))
                          | (F.abs(x.cast("double")) == float("inf"))))
    return vectors.where(usable & F.col("id").isNotNull()).select(
        "id", F.transform("vector", lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("v"))


def _lengths(frame):
    squares = F.aggregate("v", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    return frame.select("id", F.size("v").alias("dim"), "v", F.sqrt(squares).alias("length"))


def _blocks(frame, rows):
    """Rows of (id, dim, v, length) as blocks of at most ``rows`` vectors of one dimension."""
    def pack(batches):
        held, numbers = [], itertools.count(TaskContext.get().partitionId() << 32)

        def block(part):
            values = np.stack(part["v"].to_numpy())
            return {"dim": int(part["dim"].iloc[0]), "block": next(numbers), "n": len(part),
                    "longest": float(part["length"].max()),
                    "ids": part["id"].to_numpy(np.int64).tobytes(), "vectors": values.astype(np.int64).tobytes()}

        def cut(table, last):
            out = []
            for _, part in table.groupby((table["dim"] != table["dim"].shift()).cumsum(), sort=False):
                whole = len(part) if last or part.index[-1] != table.index[-1] else len(part) - len(part) % rows
                out += [block(part.iloc[i:min(i + rows, whole)]) for i in range(0, whole, rows)]
                rest = part.iloc[whole:]
            return out, rest

        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= rows:
                out, rest = cut(pd.concat(held, ignore_index=True), False)
                held = [rest] if len(rest) else []
                if out:
                    yield pd.DataFrame(out)
        if held:
            out, _ = cut(pd.concat(held, ignore_index=True), True)
            yield pd.DataFrame(out)

    # near a range's edge a block has fewer rows; blocks are only a unit of work
    ordered = frame.repartitionByRange("dim", F.desc("length"), "id")
    return ordered.sortWithinPartitions("dim", F.desc("length"), "id").mapInPandas(pack, BLOCKS)


def _unpacked(dim, ids, vectors):
    ids = np.frombuffer(ids, np.int64)
    return ids, np.frombuffer(vectors, np.int64).reshape(len(ids), dim)


def _products(queries, vectors):
    """Integer inner products; doubles where they are exact, as they are much faster."""
    limit = np.abs(queries).max(initial=0).astype(float) * np.abs(vectors).max(initial=0) * queries.shape[1]
    if limit < EXACT:
        return (queries.astype(np.float64) @ vectors.T.astype(np.float64)).astype(np.int64)
    return queries @ vectors.T


def search_block(query_ids, queries, reach, ids, vectors, k, bucket_rows=BUCKET_ROWS, focus=FOCUS):
    """The k best rows of a block for each query, as (query row, score, id) arrays.

    ``reach`` is a score for each query that its answers reach; -inf if none is
    known. Rows of the block come longest first.
    """
    lengths = np.sqrt((vectors.astype(np.float64) ** 2).sum(1))
    query_lengths = np.sqrt((queries.astype(np.float64) ** 2).sum(1))
    reach = reach.astype(np.float64).copy()
    best = [[] for _ in query_ids]
    order = np.argsort(-np.abs(queries), axis=1, kind="stable")[:, :focus]
    for first in range(0, len(ids), bucket_rows):
        part, own = vectors[first:first + bucket_rows], ids[first:first + bucket_rows]
        size = lengths[first:first + bucket_rows].max()
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = reach / (query_lengths * size)
        # scores at or below zero are reached by short vectors, too: no pruning by length
        open_ = np.flatnonzero((reach <= 0) | ~(cosine > 1 + 1e-9))
        if not len(open_):
            continue
        prune = open_[(reach[open_] > 0) & (cosine[open_] > 0.5)]
        whole = np.setdiff1d(open_, prune, assume_unique=True)
        found = []
        if len(whole):
            found.append((np.repeat(whole, len(own)), np.tile(np.arange(len(own)), len(whole)),
                          _products(queries[whole], part).reshape(-1)))
        for q in prune:
            chosen = order[q]
            head = part[:, chosen].astype(np.float64)
            seen = head @ queries[q, chosen].astype(np.float64)
            rest = np.sqrt(np.maximum((lengths[first:first + bucket_rows] ** 2 - (head ** 2).sum(1)), 0))
            left = np.sqrt(max(query_lengths[q] ** 2 - (queries[q, chosen].astype(np.float64) ** 2).sum(), 0))
            some = np.flatnonzero(seen + rest * left >= reach[q] - 1)  # a whole unit for rounding
            if len(some):
                found.append((np.full(len(some), q), some, _products(queries[q:q + 1], part[some]).reshape(-1)))
        for rows, at, scores in found:
            keep = (scores >= reach[rows]) & (own[at] != query_ids[rows])
            rows, at, scores = rows[keep], at[keep], scores[keep]
            edges = np.flatnonzero(np.diff(rows)) + 1
            for group in np.split(np.arange(len(rows)), edges):
                if not len(group):
                    continue
                q = rows[group[0]]
                if len(group) > k:
                    top = np.lexsort((own[at[group]], -scores[group]))[:k]
                    group = group[top]
                best[q] = sorted(best[q] + list(zip((-scores[group]).tolist(), own[at[group]].tolist())))[:k]
                if len(best[q]) == k:
                    reach[q] = max(reach[q], -best[q][-1][0])
    return best


def _searched(pairs, k):
    """Search every pair of a query block and a vector block."""
    def search(batches):
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                query_ids, queries = _unpacked(row["dim"], row["query_ids"], row["queries"])
                ids, vectors = _unpacked(row["dim"], row["ids"], row["vectors"])
                reach = np.frombuffer(row["reach"], np.float64)
                best = search_block(query_ids, queries, reach, ids, vectors, k)
                out = [(int(q), -score, i) for q, found in zip(query_ids, best) for score, i in found]
                yield pa.RecordBatch.from_pydict({
                    "query_id": pa.array([x[0] for x in out], pa.int64()),
                    "score": pa.array([x[1] for x in out], pa.int64()),
                    "vec_id": pa.array([x[2] for x in out], pa.int64())})

    return pairs.mapInArrow(search, "query_id bigint, score bigint, vec_id bigint")


def _ranked(found, k):
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.select("query_id", "score", "vec_id", F.row_number().over(order).alias("rank")).where(
        F.col("rank") <= k)


def _query_blocks(queries, rows=QUERY_ROWS):
    """Rows of (id, dim, v, length, reach) as blocks; ``least`` is the length that some answer must have."""
    def pack(batches):
        numbers = itertools.count(TaskContext.get().partitionId() << 32)
        for batch in batches:
            for _, same in batch.groupby("dim", sort=False):
                for first in range(0, len(same), rows):
                    part = same.iloc[first:first + rows]
                    length, reach = (part[c].to_numpy(np.float64) for c in ("length", "reach"))
                    with np.errstate(divide="ignore", invalid="ignore"):
                        least = np.where(reach > 0, reach / length, 0).min()
                    yield pd.DataFrame([{
                        "query_block": next(numbers), "dim": int(part["dim"].iloc[0]), "least": float(least),
                        "query_ids": part["id"].to_numpy(np.int64).tobytes(),
                        "queries": np.stack(part["v"].to_numpy()).astype(np.int64).tobytes(),
                        "reach": reach.tobytes()}])

    return stored(queries.mapInPandas(
        pack, "query_block bigint, dim int, least double, query_ids binary, queries binary, reach binary"),
        "query-blocks")


def _met(query_blocks, blocks):
    """Every block of queries next to every block of vectors that may hold an answer."""
    salt = F.explode(F.sequence(F.lit(0), F.lit(LANES - 1))).alias("lane")
    listed = (
        query_blocks.select("query_block", "dim", "least", salt)
        .join(blocks.select("block", "dim", "longest", F.pmod("block", F.lit(LANES)).cast("int").alias("lane")),
              ["dim", "lane"])
        .where(F.col("longest") * (1 + 1e-9) >= F.col("least"))
        .select("query_block", "block")
    )
    return listed.join(query_blocks, "query_block").join(blocks.drop("dim", "n", "longest"), "block")


def top_k(vectors, queries, k=K, block_rows=BLOCK_ROWS):
    """The k rows of ``vectors`` with the highest inner product with each row of ``queries``.

    Both have (id, v) with integer arrays v. Returns query_id, rank, vec_id, score.
    """
    queries = _lengths(queries.groupBy("id").agg(F.min("v").alias("v")))
    blocks = stored(_blocks(_lengths(vectors), block_rows), "vector-blocks")
    # one block of each dimension holds the longest vectors
    front = blocks.groupBy("dim").agg(F.max(F.struct("longest", "block")).alias("top")).select("top.block")
    first = _met(_query_blocks(queries.withColumn("reach", F.lit(float("-inf")))),
                 blocks.join(front, "block").select(blocks.columns))
    reached = _ranked(_searched(first, k), k).where(F.col("rank") == k).select(
        "query_id", F.col("score").cast("double").alias("reach"))
    known = queries.join(reached, queries["id"] == reached["query_id"], "left").select(
        "id", "dim", "v", "length", F.coalesce("reach", F.lit(float("-inf"))).alias("reach"))
    return _ranked(_searched(_met(_query_blocks(known), blocks), k), k).select(
        "query_id", "rank", "vec_id", "score")
