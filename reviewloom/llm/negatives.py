"""Hard-negative mining: each anchor's nearest rows of other labels below each of its positives.

An anchor's positives are its best rows of the same label. Every positive asks for the
best rows of other labels whose scores lie between a share of its own score and that
score, so its windows overlap. The positives' scores, the upper limits, split the
scores into disjoint slots. One pass over the vectors keeps the best few rows of every
slot: first per task, then per anchor. Sorted downwards, the slots from a positive's own
on are one run, whose first rows answer its window, cut at its lower limit. So each
product is computed once for all windows of an anchor.

Vectors travel in blocks of bounded bytes. Anchors are dealt to groups of bounded
bytes by a hash of their id, and each group meets all blocks, lane by lane: a task
holds one group and one block at a time, and a block is read once per group. Labels
play no part in how work is dealt, so a label with a third of all rows is no hot key.

Rows with a null id, a null label, a null or empty vector, or a null or non-finite
component take no part. Scores are defined between vectors of equal dimension. Equal
scores go to the smaller id. Ids of anchors should be unique: of rows that repeat an
anchor's id the one with the smallest label and vector is the anchor, all are rows of
their own, and an anchor skips every row with its own id. A positive below zero has no
window, as its lower limit would lie above it. Empty tables give an empty result.
Columns other than id, label and vector are not looked at. Components must be small
enough for a hundred times a score to be a 64-bit integer.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import stored

POSITIVES = 5
NEGATIVES = 5
SHARE = (80, 100)
BLOCK_BYTES = 1 << 20
GROUP_BYTES = 1 << 23
BLOCKS_PER_LANE = 16
TILE_ROWS = 256
EXACT = float(1 << 53)
LEAST, MOST = int(np.iinfo(np.int64).min), int(np.iinfo(np.int64).max)
BLOCKS = "dim int, block bigint, ids binary, labels binary, vectors binary"
GROUPS = "dim int, team int, ids binary, labels binary, vectors binary, uppers binary, lowers binary"


def integer_rows(vectors, scale=256):
    """(id, label, v) with v = floor(scale * x) of every row of (id, label, vector) that takes part."""
    usable = (F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()
              & (F.size("vector") > 0)
              & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x.cast("double"))
                          | (F.abs(x.cast("double")) == float("inf"))))
    return vectors.where(usable).select(
        F.col("id").cast("bigint").alias("id"), F.col("label").cast("bigint").alias("label"),
        F.transform("vector", lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("v"))


def _matrix(vectors):
    """Arrays of equal length as one matrix."""
    return np.stack(vectors.to_numpy()).astype(np.int64)


def _blocks(rows):
    """Rows as blocks of one dimension of about ``BLOCK_BYTES``."""
    def pack(batches):
        number, held = TaskContext.get().partitionId() << 32, {}

        def block(dim, part):
            nonlocal number
            number += 1
            return {"dim": dim, "block": number, "ids": part["id"].to_numpy(np.int64).tobytes(),
                    "labels": part["label"].to_numpy(np.int64).tobytes(), "vectors": _matrix(part["v"]).tobytes()}

        for batch in batches:
            for dim, part in batch.groupby(batch["v"].map(len)):
                most = max(1, BLOCK_BYTES // (8 * dim))
                part = pd.concat([held.pop(dim), part]) if dim in held else part
                whole = len(part) - len(part) % most
                for first in range(0, whole, most):
                    yield pd.DataFrame([block(dim, part.iloc[first:first + most])])
                if whole < len(part):
                    held[dim] = part.iloc[whole:]
        for dim, part in held.items():
            yield pd.DataFrame([block(dim, part)])

    return rows.mapInPandas(pack, BLOCKS)


def _groups(anchors, teams):
    """Anchors of (id, label, v, uppers, lower) as groups of one dimension, dealt by a hash of the id."""
    def pack(batches):
        for batch in batches:
            for row in batch.to_pylist():
                part = pd.DataFrame(row["members"])
                uppers = np.full((len(part), max(map(len, part["uppers"]))), LEAST)
                for at, limits in enumerate(part["uppers"]):
                    uppers[at, :len(limits)] = limits
                yield pa.RecordBatch.from_pylist([{
                    "dim": row["dim"], "team": row["team"], "ids": part["id"].to_numpy(np.int64).tobytes(),
                    "labels": part["label"].to_numpy(np.int64).tobytes(), "vectors": _matrix(part["v"]).tobytes(),
                    "uppers": uppers.tobytes(), "lowers": part["lower"].to_numpy(np.int64).tobytes()}],
                    pa.schema([(name, kind) for name, kind in zip(
                        ("dim", "team", "ids", "labels", "vectors", "uppers", "lowers"),
                        (pa.int32(), pa.int32(), *[pa.binary()] * 5))]))

    # at most about GROUP_BYTES of vectors come together in a row
    members = anchors.groupBy(
        F.size("v").alias("dim"), F.pmod(F.xxhash64("id"), F.lit(teams)).cast("int").alias("team")
    ).agg(F.collect_list(F.struct("id", "label", "v", "uppers", "lower")).alias("members"))
    return members.mapInArrow(pack, GROUPS)


def exact_products(a, b):
    """Integer inner products; by doubles where those are exact, as they are much faster."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < EXACT:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def best_of(keys, scores, ids, k):
    """Places of the k best of every key, by score downwards, then by id."""
    order = np.lexsort((ids, -scores, keys))
    keys = keys[order]
    first = np.searchsorted(keys, keys, "left")
    return order[np.arange(len(keys)) - first < k]


class Slots:
    """The best k rows of each slot of a group of anchors, over the blocks seen so far."""

    def __init__(self, group, same, k):
        self.ids, self.labels, self.lowers = (
            np.frombuffer(group[name], np.int64) for name in ("ids", "labels", "lowers"))
        self.vectors = np.frombuffer(group["vectors"], np.int64).reshape(len(self.ids), -1)
        self.uppers = np.frombuffer(group["uppers"], np.int64).reshape(len(self.ids), -1)
        self.same, self.k, self.n = same, k, self.uppers.shape[1]
        self.floor = np.full(self.uppers.size, LEAST)  # a score that a row of a full slot must reach
        self.keys = self.scores = self.found = np.zeros(0, np.int64)

    def add(self, ids, labels, vectors):
        for first in range(0, len(self.ids), TILE_ROWS):
            tile = slice(first, first + TILE_ROWS)
            scores = exact_products(self.vectors[tile], vectors)
            wanted = (self.labels[tile, None] == labels) == self.same
            wanted &= self.ids[tile, None] != ids
            wanted &= (scores <= self.uppers[tile, :1]) & (scores >= self.lowers[tile, None])
            row, at = np.nonzero(wanted)
            score = scores[row, at]
            row += first
            # limits come downwards: the slot is that of the last limit not below the score
            slot = (self.uppers[row] >= score[:, None]).sum(1) - 1
            key = row * self.n + slot
            near = score >= self.floor[key]
            self._keep(key[near], score[near], ids[at[near]])

    def _keep(self, keys, scores, ids):
        if not len(keys):
            return
        old = np.isin(self.keys, keys)  # only slots that get rows are merged
        keys, scores, ids = (np.concatenate(pair) for pair in (
            (self.keys[old], keys), (self.scores[old], scores), (self.found[old], ids)))
        kept = best_of(keys, scores, ids, self.k)
        keys, scores, ids = keys[kept], scores[kept], ids[kept]
        full = np.flatnonzero(np.bincount(keys, minlength=len(self.floor)) == self.k)
        self.floor[full] = scores[np.searchsorted(keys, full, "right") - 1]
        self.keys, self.scores, self.found = (np.concatenate(pair) for pair in (
            (self.keys[~old], keys), (self.scores[~old], scores), (self.found[~old], ids)))

    def rows(self):
        return pa.RecordBatch.from_pydict({
            "anchor_id": self.ids[self.keys // self.n], "slot": (self.keys % self.n).astype(np.int32),
            "score": self.scores, "id": self.found})


def slot_bests(blocks, anchors, same, k):
    """The k best rows of every slot of every anchor: anchor_id, slot, score, id.

    ``same``: rows of the anchor's label, or else rows of other labels. ``anchors``
    has id, label, v, uppers (limits, downwards) and lower.
    """
    size = anchors.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    teams = max(1, -(-size["n"] * 8 * (size["dim"] or 1) // GROUP_BYTES))
    lanes = max(1, -(-blocks.count() // BLOCKS_PER_LANE))
    empty = F.lit(None).cast("binary")
    groups = _groups(anchors, teams).select(
        "dim", "team", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), F.lit(0).alias("kind"),
        "ids", "labels", "vectors", "uppers", "lowers")
    rows = blocks.select(
        "dim", F.explode(F.sequence(F.lit(0), F.lit(teams - 1))).alias("team"),
        F.pmod(F.xxhash64("block"), F.lit(lanes)).cast("int").alias("lane"), F.lit(1).alias("kind"),
        "ids", "labels", "vectors", empty.alias("uppers"), empty.alias("lowers"))
    place = ["dim", "team", "lane"]

    def search(batches):
        slots = at = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["kind"] == 0:
                    if slots is not None:
                        yield slots.rows()
                    slots, at = Slots(row, same, k), [row[name] for name in place]
                elif at == [row[name] for name in place]:
                    ids, labels, vectors = (np.frombuffer(row[name], np.int64) for name in ("ids", "labels", "vectors"))
                    slots.add(ids, labels, vectors.reshape(len(ids), -1))
        if slots is not None:
            yield slots.rows()

    # a group comes first and meets the blocks of its lane one by one
    met = groups.unionByName(rows).repartition(*place).sortWithinPartitions(*place, "kind")
    found = met.mapInArrow(search, "anchor_id bigint, slot int, score bigint, id bigint")
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(rows, anchors, positives=POSITIVES, negatives=NEGATIVES, share=SHARE):
    """The best rows of other labels in the window of each positive of each anchor.

    Both frames have (id, label, v) with integer arrays v. ``share``: a window reaches
    from this part of the positive's score up to that score. Returns anchor_id,
    positive_id, rank, negative_id, positive_score, negative_score.
    """
    low, high = share
    blocks = stored(_blocks(rows), "negative-blocks")
    anchors = stored(anchors.groupBy("id").agg(F.min(F.struct("label", "v")).alias("row")).select("id", "row.*"),
                     "negative-anchors")
    everything = anchors.withColumn("uppers", F.array(F.lit(MOST))).withColumn(
        "lower", F.lit(LEAST))
    best = stored(slot_bests(blocks, everything, True, positives).select(
        "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    windows = best.where(F.col("positive_score") >= 0)
    limits = windows.groupBy(F.col("anchor_id").alias("id")).agg(
        F.reverse(F.array_sort(F.collect_set("positive_score"))).alias("uppers"),
        F.min(F.expr(f"(({low} * positive_score + {high} - 1) div {high})")).alias("lower"))
    found = slot_bests(blocks, stored(anchors.join(limits, "id"), "negative-limits"), False, negatives)
    # at most `positives` slots of `negatives` rows
    merged = found.groupBy("anchor_id").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("down"), "id"))).alias("all"))
    below = F.slice(F.filter("all", lambda x: x["down"] >= -F.col("positive_score")), 1, negatives)
    inside = F.filter(below, lambda x: -high * x["down"] >= low * F.col("positive_score"))
    return windows.join(merged, "anchor_id").select(
        "anchor_id", "positive_id", "positive_score", F.posexplode(inside).alias("at", "row")).select(
        "anchor_id", "positive_id", (F.col("at") + 1).alias("rank"), F.col("row.id").alias("negative_id"),
        "positive_score", (-F.col("row.down")).alias("negative_score"))
