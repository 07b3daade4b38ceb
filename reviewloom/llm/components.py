"""Connected components of a table of links, by DataFrame joins.

Large and small stars take turns: every id links its neighbours to the smallest id
it knows, until the links are stars around the smallest ids. Each turn's links are
written to the shared folder, so a turn never recomputes an earlier one. A turn adds
no links, and the smallest neighbours are combined in each task before the shuffle, so
an id with very many links is no single task's work.
"""

from pyspark.sql import functions as F

from ..session import stored

MOST_TURNS = 60


def _large_star(links):
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("least"))
    least = least.select("a", F.least("a", "least").alias("least"))
    return (
        both.where("b > a").join(least, "a")
        .select(F.col("b").alias("a"), F.col("least").alias("b"))
    )


def _small_star(links):
    least = links.groupBy("a").agg(F.min("b").alias("least"))
    return (
        links.join(least, "a").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        .unionByName(least.select("a", F.col("least").alias("b")))
    )


def _state(links):
    row = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def components(links):
    """(id, component_id) of every id in the links (a, b): the smallest id it can reach.

    Null ends and links of an id to itself are left out. Ids without links do not appear.
    """
    current = stored(
        links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = _state(current)
    for _ in range(MOST_TURNS):
        current = stored(_small_star(_large_star(current).distinct()).where("a <> b").distinct(), "links")
        before, state = state, _state(current)
        if state == before:
            break
    else:
        raise RuntimeError(f"links are not settled after {MOST_TURNS} turns")
    return (
        current.select(F.col("a").alias("id"), F.col("b").alias("component_id"))
        .unionByName(current.select(F.col("b").alias("id"), F.col("b").alias("component_id"))).distinct()
    )


def local_forest(count, pairs):
    """A forest over 0..count-1 that joins the same members as ``pairs`` do: (member, root) pairs."""
    root = list(range(count))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in pairs:
        i, j = find(i), find(j)
        if i != j:
            root[max(i, j)] = min(i, j)
    return [(i, find(i)) for i in range(count) if root[i] != i]
