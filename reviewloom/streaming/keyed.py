"""State per tenant and game: running counts, flags, top-N, percentile.

State grows with the number of games, never with the number of reviews. The
aggregations run in update mode: a micro-batch emits the keys it changed, and the
epoch log holds their versions.
"""

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import count_flags, non_empty, percentile_cut, top_n
from .epochs import answered, epochs_of, folders, latest, log_view, newest_view, run_epochs, start_log, written_view
from .processors import state_rows, tenant_states
from .purges import MARK, with_purges

KEYS = ["client_id", "app_id"]
FIRST = -(1 << 63)
BLOCK_BITS = 9  # a block of state has the games of 512 neighbouring ids, those of its lane
MERGE_ROWS = 1 << 20

COUNTS = T.StructType([
    T.StructField("client_id", T.LongType()),
    T.StructField("app_id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("stat", T.LongType()),
])


def keyed_counts(tagged):
    """Name and number of reviews per (client_id, app_id), either input first.

    ``tagged`` has ``is_review``, and for catalogue rows ``name`` and ``seq``; the
    name with the largest ``seq`` wins. Works on batch and streaming frames.
    """
    # never null, so that the state looks the same while one of the inputs is idle
    seq = F.coalesce("seq", F.lit(FIRST).cast("bigint")).alias("seq")
    named = F.when(~F.col("is_review"), F.struct(seq, "name"))
    return tagged.groupBy(*KEYS).agg(
        F.max(named)["name"].alias("name"),
        F.count_if("is_review").alias("stat"),
    )


def running_flags(stream, flags):
    """Running counts of true flags per tenant."""
    return count_flags(stream, flags, by=("client_id",))


def run_top(stats, n, path, checkpoint, schema=COUNTS, growing=True, **options):
    """Keep the top n per tenant of a stream.

    ``growing``: an update-mode stream of counts. They only grow, so a key that
    neither changed nor was in the last top n cannot enter it: the new one is drawn
    from the old one and the changed keys. Otherwise every row stands for itself.
    """
    start_log(stats.sparkSession, path, schema)
    columns = schema.fieldNames()
    values = [name for name in columns if name not in KEYS]

    def handle(rows, epoch):
        old = newest_view(rows.sparkSession, path, schema, before=epoch)
        both = old.withColumn("epoch", F.lit(epoch - 1).cast("bigint")).unionByName(
            rows.select(*columns).withColumn("epoch", F.lit(epoch).cast("bigint"))
        )
        candidates = latest(both, KEYS, values) if growing else both
        return top_n(candidates, n, by=("client_id",)).select(*columns)

    mode = "update" if growing else "append"
    query = run_epochs(stats, handle, path, checkpoint, mode, **options)
    return answered(query, lambda: top_view(stats.sparkSession, path, schema))


def top_view(spark, path, schema=COUNTS):
    """The rows of the newest epoch of a log that holds a whole answer per epoch."""
    return newest_view(spark, path, schema)


def compact_top(spark, path, to, schema=COUNTS):
    """Start a new log with only the newest answer of a log of whole answers.

    Stop the query, compact its log to a new folder, and go on with that folder and the
    same checkpoint. (``compact_log`` is for logs of changed keys.)
    """
    top_view(spark, path, schema).write.parquet(f"{to}/epoch=-1")


def run_percentile(counts, p, path, checkpoint, complete=None, **options):
    """Accumulate counts; answer the percentile per tenant once it is complete.

    ``complete`` is a frame of the tenants whose stream has ended without gaps;
    without it, all tenants are taken as complete. The log of the counts is compacted
    by itself. ``run_histograms`` keeps the ranks up to date instead.
    """
    spark = counts.sparkSession
    start_log(spark, path, COUNTS)
    columns = COUNTS.fieldNames()

    def view():
        stats = non_empty(latest(written_view(spark, path, COUNTS), KEYS, ["name", "stat"]))
        if complete is not None:
            stats = stats.join(complete.select("client_id"), "client_id", "left_semi")
        return percentile_cut(stats, p, by=("client_id",))

    return answered(run_epochs(
        counts, lambda rows, epoch: rows.select(*columns), path, checkpoint, "update", keys=KEYS, **options
    ), view)


CHANGES = "app_id bigint, name string, was bigint, stat bigint"
HISTOGRAM = T.StructType([
    T.StructField("client_id", T.LongType()),
    T.StructField("stat", T.LongType()),
    T.StructField("games", T.LongType()),
])


class GameCounts:
    """Name and number of reviews of each game of a lane, and how they changed.

    A game counts once it has a name and a review. ``was`` and ``stat`` are its reviews
    before and after the micro-batch, 0 while it does not count. The rows of a frame are
    counted at once, and the state is read and written by blocks of neighbouring ids, as
    each call costs far more than what it brings; ``held_games`` gives its games.
    """

    states = {"games": ("block bigint", "ids array<bigint>, seqs array<bigint>, names array<string>, stats array<bigint>")}

    def rows(self, key, frames, state):
        ids, reviews, names = self._met(frames)
        blocks = ids >> BLOCK_BITS
        starts = np.flatnonzero(np.diff(blocks, prepend=blocks[:1] - 1))
        for start, end in zip(starts, [*starts[1:], len(ids)]):
            block = (int(blocks[start]),)
            before = state.games.getValue(block)
            held = {} if before is None else {app_id: game for app_id, *game in zip(*before)}
            changes = []
            for app_id, more in zip(ids[start:end].tolist(), reviews[start:end].tolist()):
                old_seq, old_name, old = held.get(app_id, (None, None, 0))
                seq, name = names.get(app_id, (None, None))
                if seq is None or (old_seq is not None and (old_seq, old_name or "") > (seq, name or "")):
                    seq, name = old_seq, old_name
                held[app_id] = seq, name, old + more
                changes.append((app_id, name, old if old_name else 0, old + more if name else 0))
            state.games.updateValue(block, (list(held), *map(list, zip(*held.values()))))
            yield from changes

    def _met(self, frames):
        """The games of all frames in order of their ids, their reviews, and their newest (seq, name)."""
        parts, size, names = [], 0, {}
        for frame in frames:
            review = frame["is_review"].to_numpy(dtype=bool)
            parts.append(_summed([(frame["app_id"].to_numpy(), review.astype("int64"))]))
            size += len(parts[-1][0])
            if size > MERGE_ROWS + 2 * len(parts[0][0]):
                parts = [_summed(parts)]
                size = len(parts[0][0])
            named = frame[~review]
            for app_id, seq, name in zip(named["app_id"].tolist(), named["seq"].tolist(), named["name"].tolist()):
                if app_id not in names or (seq, name or "") > (names[app_id][0], names[app_id][1] or ""):
                    names[app_id] = seq, name
        ids, reviews = _summed(parts)
        return ids, reviews, names


def _summed(parts):
    """The numbers of each id, summed over all parts (ids, numbers)."""
    if not parts:
        return np.zeros(0, "int64"), np.zeros(0, "int64")
    ids, places = np.unique(np.concatenate([part[0] for part in parts]), return_inverse=True)
    sums = np.zeros(len(ids), "int64")
    np.add.at(sums, places, np.concatenate([part[1] for part in parts]))
    return ids, sums


def held_games(spark, checkpoint, epoch=None):
    """client_id, app_id, name and stat of the games in the state of ``tenant_counts``."""
    blocks = state_rows(spark, checkpoint, "games", epoch)
    games = F.arrays_zip(*[F.col(f"user_map_value.{name}").alias(name) for name in ("ids", "names", "stats")])
    return blocks.select("key.client_id", F.explode(games).alias("game")).select(
        "client_id", F.col("game.ids").alias("app_id"), F.col("game.names").alias("name"),
        F.col("game.stats").alias("stat"))


def tenant_counts(tagged, lanes=8, control=None):
    """``keyed_counts`` whose state a purge clears: client_id, lane, purged, app_id, name, was, stat.

    Rows without an app_id belong to no game.
    """
    rows = tagged.filter("app_id is not null").select("client_id", "app_id", "name", "seq", "is_review")
    marked = rows if control is None else with_purges(rows, control)
    # a null, also that of a mark, would turn the numbers next to it into floating point in Python
    marked = marked.withColumns({
        "app_id": F.coalesce("app_id", F.lit(0)),
        "seq": F.coalesce("seq", F.lit(FIRST).cast("bigint")),
        "is_review": F.coalesce("is_review", F.lit(False))})
    return tenant_states(marked, GameCounts(), CHANGES, maps=GameCounts.states, lanes=lanes, lane_key="app_id")


def run_histograms(tagged, folder, lanes=8, control=None, p=90, **options):
    """Keep a histogram of review counts per tenant; the p-th percentile is read off it at any time.

    A micro-batch moves the games it changed from their old count to their new one, so
    its work follows those games and the number of different counts, and an answer reads
    no older epoch: the cut comes from the newest histogram, the games above it from the
    state that the counts are kept in. Both are taken at the last finished micro-batch.
    """
    spark = tagged.sparkSession
    log, checkpoint = f"{folder}/histograms", f"{folder}/checkpoint"
    start_log(spark, log, HISTOGRAM)

    def handle(rows, epoch):
        session = rows.sparkSession
        marks = rows.filter(MARK).select("client_id").distinct()
        moved = rows.filter(~F.col(MARK)).select("client_id", F.inline(F.array(
            F.struct(F.col("was").alias("stat"), F.lit(-1).cast("bigint").alias("games")),
            F.struct(F.col("stat").alias("stat"), F.lit(1).cast("bigint").alias("games")))))
        old = newest_view(session, log, HISTOGRAM, before=epoch)
        both = old.unionByName(moved.filter("stat > 0")).join(marks, "client_id", "left_anti")
        return both.groupBy("client_id", "stat").agg(F.sum("games").alias("games")).filter("games > 0")

    def forget(session, epoch):
        # a repeated epoch needs the one before it
        system, found = folders(session, f"{log}/epoch=*")
        for path in found:
            if int(path.getName()[6:]) < epoch - 1:
                system.delete(path, True)

    query = run_epochs(
        tenant_counts(tagged, lanes, control), handle, log, checkpoint, "update", after=forget, once=True, **options)
    return answered(query, lambda: histogram_percentile(spark, folder, p))


def histogram_percentile(spark, folder, p, complete=None):
    """The percentile answer of ``run_histograms`` at its last finished micro-batch."""
    _, commits = folders(spark, f"{folder}/checkpoint/commits/*")
    done = max((int(x.getName()) for x in commits if x.getName().isdigit()), default=None)
    if done is None or done not in epochs_of(spark, f"{folder}/histograms"):
        return spark.createDataFrame([], COUNTS)
    ranks = log_view(spark, f"{folder}/histograms", HISTOGRAM, only=done).drop("epoch")
    games = held_games(spark, f"{folder}/checkpoint", done)
    if complete is not None:
        games = games.join(complete.select("client_id"), "client_id", "left_semi")
    return percentile_cut(non_empty(games), p, by=("client_id",), counted=ranks)
