"""Near-duplicate documents by bottom-k sketches of one hash function.

A document is the set of its shingles (runs of words); its sketch is the k smallest
hashes of that set. Inverted lists go from retained values to documents: an entry is
a run of three neighbouring values of a sketch, which similar documents share nearly
always and documents that only have a common line almost never.

1. Documents with equal sets are one representative, by a 128-bit digest of the set.
2. In each list every representative meets the smallest one. The union of both sketches
   estimates their similarity; pairs that may belong together, by a wide margin, are
   kept, and what is left of a list meets once more among itself without that filter. Those
   kept by so little that a near-copy may be left meet it there, too. So near-copies that
   share a list end up in one candidate group, without all pairs of a list.
3. Each candidate group fetches its documents' whole sets, in chunks, and every pair of
   chunks verifies all of its pairs by exact Jaccard similarity. A task returns a forest
   of the links it found, never the links themselves.
4. Components of the forests are the near-duplicate groups.

A pair at the threshold is missed if no three neighbouring values of its union sketch
are shared: with the default 34 values 7 in a million for 0.8 and 3 in ten millions for
0.85, fewer above. Sets of at most 34 values are not missed: they are listed whole, with
at least four shared values for each other one, and those of fewer than six values by
runs of two as well.

A null or wordless text has an empty set and links with nothing. A text with fewer words
than a shingle is one shingle. Rows that repeat an id are one document: their sets must
be equal, and each row is returned. Null ids are returned with their set's size, unlinked.
An empty table gives an empty result.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..session import discard, stored
from . import texts
from .components import components, local_forest

SHINGLE_WORDS = 5
SIMILARITY = (80, 100)
RETAINED = 64
LISTED = 34
RUN = 3
LOOSE = 0.25
SAMPLING = 0.1
CHUNK_SETS = 400
COLUMN_BLOCK = 4096

SKETCHES = "doc_id bigint, n_shingles bigint, digest_a bigint, digest_b bigint, sketch binary, entries array<bigint>"


def shingle_sets(data, offsets, n_words):
    """Distinct shingle hashes of each text of a slice: (hashes sorted by text and value, text numbers)."""
    starts, ends, owners = texts.words(data, offsets)
    hashes = texts.word_hashes(data, starts, ends, lower=True)
    values, first = texts.runs_of(hashes, owners, n_words)
    owner = owners[first]
    begin, end = texts.group_bounds(owners, len(offsets) - 1)
    short = np.flatnonzero((end > begin) & (end - begin < n_words))
    if len(short):
        own = [texts.runs_of(hashes[b:e], np.zeros(e - b), e - b)[0][0] for b, e in zip(begin[short], end[short])]
        values = np.concatenate((values, np.array(own, np.uint64)))
        owner = np.concatenate((owner, short))
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    if len(values):
        new = np.concatenate(([True], (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])))
        values, owner = values[new], owner[new]
    return values, owner


def sketched(documents, n_words=SHINGLE_WORDS, retained=RETAINED, listed=LISTED):
    """Set size, digest, sketch and list entries of every row of (doc_id, text)."""
    def sketch(batches):
        for batch in batches:
            ids = batch.column(0)
            for start, data, offsets in texts.slices(batch.column(1)):
                n = len(offsets) - 1
                values, owner = shingle_sets(data, offsets, n_words)
                begin, end = texts.group_bounds(owner, n)
                sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)))
                        for x in (values, texts.mix(values))]
                digests = [(s[end] - s[begin]).view(np.int64) for s in sums]
                sketches, entries = [], []
                for b, e in zip(begin.tolist(), end.tolist()):
                    own = values[b:min(e, b + retained)]
                    sketches.append(own.tobytes())
                    head = own[:listed]
                    runs = [texts.runs_of(head, np.zeros(len(head), np.int8), n)[0]
                            for n in ((RUN, RUN - 1) if len(head) < 2 * RUN else (RUN,))]
                    entries.append(np.concatenate(runs).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(start, n), pa.array(end - begin), *map(pa.array, digests),
                     pa.array(sketches, pa.binary()), pa.array(entries, pa.list_(pa.int64()))],
                    ["doc_id", "n_shingles", "digest_a", "digest_b", "sketch", "entries"])

    return documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(texts.released(sketch), SKETCHES)


def estimate(a, b, retained=RETAINED):
    """Estimated Jaccard similarity of two sets from their sketches."""
    union = np.union1d(a, b)[:retained]
    return np.isin(union, a, assume_unique=True)[np.isin(union, b, assume_unique=True)].sum() / max(1, len(union))


def _estimated(pairs, retained):
    """Adds ``alike``, the estimate for the sketches a_sketch and b_sketch of a pair."""
    def compare(batches):
        for batch in batches:
            a, b = (batch.column(c).to_pylist() for c in ("a_sketch", "b_sketch"))
            alike = [estimate(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), retained)
                     for x, y in zip(a, b)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(alike, pa.float64())], ["a", "b", "alike"])

    return pairs.mapInArrow(texts.released(compare), "a bigint, b bigint, alike double")


def _met(entries):
    """Members of each list next to its smallest member: (entry, a, b)."""
    least = entries.groupBy("entry").agg(F.min("id").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    return entries.join(least, "entry").where("id <> b").select("entry", F.col("id").alias("a"), "b")


def candidate_links(representatives, retained=RETAINED, loose=LOOSE, similarity=SIMILARITY, sampling=SAMPLING):
    """Links (a, b) whose components hold every pair at the threshold that shares a list entry.

    One minus the similarity is a distance: if one of a pair is below ``loose``, the other is
    less than the pair's distance above it. Estimates add ``sampling``; they are exact for
    unions of at most ``retained`` values.
    """
    entries = representatives.select(F.col("rep").alias("id"), F.explode("entries").alias("entry")).distinct()
    met = stored(_met(entries), "met")
    sketches = representatives.select(F.col("rep"), "sketch")
    pairs = met.select("a", "b").distinct()
    pairs = pairs.join(sketches.withColumnsRenamed({"rep": "a", "sketch": "a_sketch"}), "a")
    pairs = pairs.join(sketches.withColumnsRenamed({"rep": "b", "sketch": "b_sketch"}), "b")
    alike = stored(_estimated(pairs, retained), "estimates")
    near = alike.where(F.col("alike") >= loose).select("a", "b")
    within = loose + 1 - similarity[0] / similarity[1] + sampling
    rest = met.join(alike.where(F.col("alike") < within).select("a", "b"), ["a", "b"]).select(
        F.col("a").alias("id"), "entry")
    links = stored(near.unionByName(_met(rest).select("a", "b")), "candidate-links")
    discard(met, alike)
    return links


def _shared_counts(left, right):
    """Sizes of the intersections of two lists of sorted sets, as a matrix."""
    values = np.concatenate(left + right)
    owner = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in left + right])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.concatenate(([True], values[1:] != values[:-1]))
    column = np.cumsum(new) - 1
    several = np.bincount(column)[column] > 1
    owner, column = owner[several], column[several]
    if not len(column):
        return np.zeros((len(left), len(right)), np.int64)
    column = np.unique(column, return_inverse=True)[1]
    total = np.zeros((len(left), len(right)), np.float32)
    edges = np.searchsorted(column, np.arange(0, column[-1] + 1 + COLUMN_BLOCK, COLUMN_BLOCK))
    for block, (b, e) in enumerate(zip(edges[:-1], edges[1:])):
        there = np.zeros((len(left) + len(right), COLUMN_BLOCK), np.float32)
        there[owner[b:e], column[b:e] - block * COLUMN_BLOCK] = 1
        total += there[:len(left)] @ there[len(left):].T
    return total.astype(np.int64)


def verified_links(left, right, similarity):
    """Index pairs (i, j) of two lists of sets whose Jaccard similarity reaches ``similarity``."""
    part, whole = similarity
    shared = _shared_counts(left, right)
    sizes = [np.array([len(x) for x in side], np.int64) for side in (left, right)]
    union = sizes[0][:, None] + sizes[1][None, :] - shared
    return np.nonzero((shared > 0) & (whole * shared >= part * union))


def _verified(dealt, n_words, similarity):
    """A forest of the exact links of each group of (grp, first, second, chunk, id, text), sorted by those."""
    def groups(batches):
        key, held = None, {}
        for batch in batches:
            values = [batch.column(c).to_pylist() for c in ("grp", "first", "second", "chunk", "id")]
            sets = [None] * batch.num_rows
            for start, data, offsets in texts.slices(batch.column("text")):
                hashes, owner = shingle_sets(data, offsets, n_words)
                begin, end = texts.group_bounds(owner, len(offsets) - 1)
                for i, (b, e) in enumerate(zip(begin.tolist(), end.tolist())):
                    sets[start + i] = hashes[b:e].copy()
            for *own, chunk, i, members in zip(*values, sets):
                if own != key:
                    if held:
                        yield key, held
                    key, held = own, {}
                held.setdefault(chunk, {})[i] = members
        if held:
            yield key, held

    def verify(batches):
        for (_, first, second), held in groups(batches):
            left, right = (held.get(c, {}) for c in (first, second))
            if not left or not right:
                continue
            ids = list(left) if first == second else list(left) + list(right)
            i, j = verified_links(list(left.values()), list(right.values()), similarity)
            j = j if first == second else j + len(left)
            forest = local_forest(len(ids), zip(i.tolist(), j.tolist()))
            yield pa.RecordBatch.from_pydict({
                "a": pa.array([ids[x] for x, _ in forest], pa.int64()),
                "b": pa.array([ids[y] for _, y in forest], pa.int64())})

    return dealt.mapInArrow(texts.released(verify), "a bigint, b bigint")


def near_documents(documents, n_words=SHINGLE_WORDS, similarity=SIMILARITY, chunk_sets=CHUNK_SETS):
    """doc_id, n_shingles, component_id and kept of every row of (doc_id, text).

    Two documents are linked if similarity[1] * shared >= similarity[0] * union holds
    for their shingles. ``kept`` marks the smallest id of each component.
    """
    table = stored(sketched(documents, n_words), "sketches")
    digest = ["n_shingles", "digest_a", "digest_b"]
    filled = table.where("n_shingles > 0 AND doc_id IS NOT NULL")
    representatives = stored(
        filled.groupBy(*digest).agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch"),
                                    F.first("entries").alias("entries")), "representatives")
    links = candidate_links(representatives, similarity=similarity)
    groups = stored(components(links).withColumnRenamed("component_id", "grp"), "groups")
    # sketches and list entries have done their work
    sketches, table = table, stored(table.select("doc_id", *digest), "digests")
    wide, representatives = representatives, stored(representatives.select(*digest, "rep"), "representative-ids")
    discard(sketches, wide, links)
    sizes = groups.groupBy("grp").agg(F.ceil(F.count("*") / chunk_sets).cast("int").alias("chunks"))
    members = groups.join(sizes, "grp").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    # by the same kind of join at every size: the members grow with the documents
    fetched = documents.select(F.col("doc_id").cast("bigint").alias("id"), "text").join(members.hint("merge"), "id")
    dealt = (
        fetched.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .withColumn("first", F.least("chunk", "other")).withColumn("second", F.greatest("chunk", "other"))
        .select("grp", "first", "second", "chunk", "id", "text")
        .repartition("grp", "first", "second").sortWithinPartitions("grp", "first", "second", "chunk", "id")
    )
    joined = components(_verified(dealt, n_words, similarity))
    component = representatives.join(joined, F.col("rep") == F.col("id"), "left").select(
        *digest, F.coalesce("component_id", "rep").alias("of_set"))
    return (
        table.select("doc_id", *digest).join(component, digest, "left")
        .select("doc_id", "n_shingles",
                F.when(F.col("doc_id").isNotNull(), F.coalesce("of_set", "doc_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
