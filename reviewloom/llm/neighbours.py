"""Near-duplicate vectors by collisions of one-dimensional projections.

Vectors of one label are projected on many random directions. A pair collides in a
projection if one lies in the window around the other; pairs with enough collisions
are verified by their cosine in double precision. Window and number are calibrated:
the number is the largest one that a pair at exactly the threshold reaches with the
recall asked for, from the binomial law of its collisions.

Equal vectors are one representative with a multiplicity, so copies are never paired.
Labels with many representatives are cut into cells by the first projections: at each
cut both sides keep the vectors near the middle, so that a near pair is together on
some side, and a pair is counted only on the first side that both are on. Cells of
near-identical vectors that cuts cannot part are dealt as pairs of chunks. A task
returns link counts and a forest of the links it found, never the links themselves.

Links need equal, non-null labels and equal dimensions. Null, zero or non-finite
vectors link with nothing. Rows that repeat an id are vectors of their own, and count
as each other's copies; the component of an id is that of all of its rows. Rows with
a null id are returned as they are, without links. An empty table gives an empty result.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import stored
from .components import components, local_forest

COSINE = 0.98
PROJECTIONS = 32
RECALL = 0.9999
WINDOW = 1.75          # half width, in standard deviations of a threshold pair's difference
MARGIN = 1.6           # of a cut, in the same unit: pairs differ by less than twice this
CELL_ROWS = 1500
CHUNK_ROWS = 1024
_SEED = 20240607


def needed_collisions(projections=PROJECTIONS, window=WINDOW, recall=RECALL):
    """Collisions that a pair at the threshold has with probability ``recall`` at least."""
    p = math.erf(window / math.sqrt(2))
    total = 0.0
    for count in range(projections, -1, -1):
        total += math.comb(projections, count) * p ** count * (1 - p) ** (projections - count)
        if total >= recall:
            return count
    return 0


def directions(dim, projections=PROJECTIONS):
    return np.random.default_rng([_SEED, dim]).standard_normal((dim, projections))


def cuts_needed(rows, cell_rows=CELL_ROWS):
    """Cuts after which a cell of evenly spread vectors has at most ``cell_rows``; a cut keeps about 0.63."""
    return F.greatest(F.lit(0), F.ceil(F.log(F.col(rows) / F.lit(float(cell_rows))) / math.log(1 / 0.63))).cast("int")


def unit_vectors(vectors):
    """Rows of (id, label, vector) that can link, with the unit vector as bytes of doubles."""
    def scale(batches):
        for batch in batches:
            out = []
            for i, label, vector in zip(*(batch.column(j).to_pylist() for j in range(3))):
                if i is None or label is None or not vector or None in vector:
                    continue
                x = np.array(vector, np.float64)
                if not np.isfinite(x).all() or not x.any():
                    continue
                x = x / np.abs(x).max()
                out.append((i, label, len(x), (x / np.sqrt((x * x).sum()) + 0.0).tobytes()))
            yield pa.RecordBatch.from_pydict({
                "id": pa.array([r[0] for r in out], pa.int64()), "label": pa.array([r[1] for r in out], pa.int64()),
                "dim": pa.array([r[2] for r in out], pa.int32()), "unit": pa.array([r[3] for r in out], pa.binary())})

    return vectors.select(F.col("id").cast("bigint"), F.col("label").cast("bigint"), "vector").mapInArrow(
        scale, "id bigint, label bigint, dim int, unit binary")


def _matrix(units, dim):
    return np.frombuffer(b"".join(units), np.float64).reshape(-1, dim)


def _in_cells(representatives, sigma, margin):
    """Every representative once for each cell it is in: (cell, sides, ...).

    ``cell`` has a bit for each cut; ``sides`` has the bits of the cuts of which the
    vector is also on side 0.
    """
    def deal(batches):
        for batch in batches:
            out = {"cell": [], "sides": [], "row": []}
            dims, cuts = batch.column("dim").to_numpy(), batch.column("cuts").to_numpy()
            units = batch.column("unit").to_pylist()
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                count = int(cuts[rows].max(initial=0))
                values = _matrix([units[i] for i in rows], dim) @ directions(dim, PROJECTIONS + count)[:, PROJECTIONS:]
                for i, own in zip(rows, values):
                    cells, sides = [0], 0
                    for c in range(cuts[i]):
                        low, high = own[c] <= margin * sigma, own[c] >= -margin * sigma
                        sides |= int(low) << c
                        cells = ([x for x in cells] if low else []) + ([x | 1 << c for x in cells] if high else [])
                    out["cell"] += cells
                    out["sides"] += [sides] * len(cells)
                    out["row"] += [i] * len(cells)
            rest = batch.take(pa.array(out["row"], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["cell"], pa.int64()), pa.array(out["sides"], pa.int64()),
                 *(rest.column(c) for c in ("label", "dim", "id", "copies", "unit"))],
                ["cell", "sides", "label", "dim", "id", "copies", "unit"])

    return representatives.mapInArrow(
        deal, "cell bigint, sides bigint, label bigint, dim int, id bigint, copies bigint, unit binary")


def candidate_pairs(left, right, sigma, needed, window=WINDOW, projections=PROJECTIONS):
    """Index pairs (i, j) that collide in at least ``needed`` projections.

    Each projection of ``right`` is sorted; each row of ``left`` is a query whose window
    is found there by bisection.
    """
    a, b = (x @ directions(x.shape[1]) for x in (left, right))
    counts = np.zeros((len(left), len(right)), np.uint8)
    for p in range(projections):
        order = np.argsort(b[:, p], kind="stable")
        ordered = b[order, p]
        low = np.searchsorted(ordered, a[:, p] - window * sigma, "left")
        high = np.searchsorted(ordered, a[:, p] + window * sigma, "right")
        for row, (x, y) in enumerate(zip(low.tolist(), high.tolist())):
            counts[row, order[x:y]] += 1
    return np.nonzero(counts >= needed)


def _links_in(left, right, cell, same, sigma, needed, cosine):
    """Verified links between the rows of two chunks of a cell, each pair in its first common cell only."""
    i, j = candidate_pairs(left["unit"], right["unit"], sigma, needed)
    if same:
        i, j = i[i < j], j[i < j]
    both = left["sides"][i] & right["sides"][j] & cell
    i, j = i[both == 0], j[both == 0]
    keep = np.concatenate([np.zeros(0, bool), *(
        np.einsum("ij,ij->i", left["unit"][i[k:k + 65536]], right["unit"][j[k:k + 65536]]) >= cosine
        for k in range(0, len(i), 65536))])
    return i[keep], j[keep]


def _compare(groups, cosine):
    """Link counts and a forest of links of rows dealt to (label, dim, cell, first, second)."""
    sigma, needed = math.sqrt(2 - 2 * cosine), needed_collisions()
    keys = ["label", "dim", "cell", "first", "second"]

    def compare(table):
        dim, cell, first, second = (table.column(c)[0].as_py() for c in keys[1:])
        chunk = table.column("chunk").to_numpy()
        parts = []
        for number in (first, second):
            rows = np.flatnonzero(chunk == number)
            parts.append({"unit": _matrix([table.column("unit")[int(r)].as_py() for r in rows], dim),
                          "sides": table.column("sides").to_numpy()[rows],
                          "copies": table.column("copies").to_numpy()[rows],
                          "id": table.column("id").to_numpy()[rows]})
        left, right = parts
        same = first == second
        i, j = _links_in(left, right, cell, same, sigma, needed, cosine)
        ids = left["id"] if same else np.concatenate((left["id"], right["id"]))
        copies = left["copies"] if same else np.concatenate((left["copies"], right["copies"]))
        j = j if same else j + len(left["id"])
        links = (np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))).astype(np.int64)
        root = np.arange(len(ids))
        for member, top in local_forest(len(ids), zip(i.tolist(), j.tolist())):
            root[member] = top
        found = np.flatnonzero(links)
        return pa.Table.from_pydict({"id": pa.array(ids[found], pa.int64()),
                                     "n_links": pa.array(links[found], pa.int64()),
                                     "linked_to": pa.array(ids[root[found]], pa.int64())})

    return groups.groupBy(*keys).applyInArrow(compare, "id bigint, n_links bigint, linked_to bigint")


def near_vectors(vectors, cosine=COSINE, cell_rows=CELL_ROWS, chunk_rows=CHUNK_ROWS):
    """n_links, component_id and kept of every row of (id, label, vector).

    Returns id, n_links, component_id, kept. ``cosine`` near 1 is assumed: the cells'
    margin and the windows follow from the distance of a pair at the threshold.
    """
    sigma = math.sqrt(2 - 2 * cosine)
    units = stored(unit_vectors(vectors), "units")
    rows = units.groupBy("label", "dim", "unit").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    representatives = stored(rows, "representatives")
    sizes = representatives.groupBy("label", "dim").agg(F.count("*").alias("n")).withColumn(
        "cuts", cuts_needed("n", cell_rows)).drop("n")
    cells = stored(_in_cells(representatives.join(sizes, ["label", "dim"]), sigma, MARGIN), "cells")
    chunks = cells.groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / chunk_rows).cast("int").alias("chunks"))
    own = F.pmod(F.xxhash64("unit"), F.col("chunks")).cast("int")
    dealt = (
        cells.join(chunks, ["label", "dim", "cell"]).withColumn("chunk", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .withColumn("first", F.least("chunk", "other")).withColumn("second", F.greatest("chunk", "other"))
    )
    found = stored(_compare(dealt, cosine), "vector-links")
    # ids of one representative's copies, and of rows that repeat an id, belong together
    members = units.join(representatives.withColumnRenamed("id", "first_id"), ["label", "dim", "unit"]).select(
        "id", "first_id", "copies")
    links = found.select(F.col("id").alias("a"), F.col("linked_to").alias("b")).unionByName(
        members.where("id <> first_id").select(F.col("id").alias("a"), F.col("first_id").alias("b")))
    whole = components(links)
    counts = members.join(
        found.groupBy(F.col("id").alias("first_id")).agg(F.sum("n_links").alias("near")), "first_id", "left").select(
        "id", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"))
    # an id that several rows repeat: its rows keep their own counts, in order
    numbered = Window.partitionBy("id").orderBy("n_links")
    counts = counts.withColumn("turn", F.row_number().over(numbered))
    linkable = F.col("vector").isNotNull() & F.col("label").isNotNull() & F.col("id").isNotNull()
    rows = vectors.select(F.col("id").cast("bigint"), linkable.alias("linkable"))
    turn = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("linkable")))
    rows = rows.withColumn("turn", F.when(F.col("id").isNull(), 0).otherwise(turn))
    return (
        rows.join(counts, ["id", "turn"], "left").join(whole, "id", "left")
        .select("id", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"),
                F.coalesce("component_id", "id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))
    )
