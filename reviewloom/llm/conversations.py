"""Conversation prefix trie, built as a burst trie: heads over containers of suffixes.

A conversation is a sequence of turns, a turn is known by the hash of its role and
text, and a prefix by the chained hash of its turns (128 bits each). Texts stay where
they are read. Equal conversations are one sequence with a multiplicity.

Every prefix that more than ``CONTAINER`` different sequences share is a head of the
trie: a container that grew too large has burst by its next turn. Heads are found by
counting prefixes of the containers still too large, 4 turns deeper at first, then 8,
16 and so on, so rounds are few however long the shared beginnings are. What is below
the heads lies in containers of a bounded number of sequences. These are sharded,
sorted and swept: neighbours in the order share the path that both begin with, so one
stack of the length of a conversation gives all nodes of a container with the sums of
their subtrees. The sums of the containers then go up to all heads above them at once.

The ids of conversations that end at a node are written as text by ranges in order,
and the texts of a node are hashed one after the other, so no task holds them all.

Turns are ordered by their number, null first; equal numbers by role and then by the
hash of the turn. Null roles and texts count as empty, repeated rows as turns of their
own, rows without a conversation id take no part, a turn without words saves nothing.
A text may be as long as a row can be. An empty table gives an empty result. Columns
other than conv_id, turn, role and text are not looked at. The turns of one
conversation, 24 bytes each, are one record and must fit in a task.
"""

import hashlib

import pyarrow as pa
from pyspark.sql import functions as F

from ..session import stored
from .mixing import word_count

CONTAINER = 256
FIRST_STEP = 4
HEADS = 4
FAMILY = 20
CHUNK = 1 << 16
ROOT = b""
TURNS = "array<struct<id:binary,words:bigint>>"
NODES = ("key binary, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, "
         "n_leaves bigint, saved_tokens bigint, path array<binary>")
SEQUENCES = "conv_id bigint, key binary, keys array<binary>, words array<bigint>"


def turn_sequences(conversations):
    """(conv_id, turns) of every conversation, its turns in order as (id, words)."""
    role, text = (F.coalesce(F.col(name), F.lit("")) for name in ("role", "text"))
    named = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    turn_id = F.unhex(F.substring(F.sha2(named.cast("binary"), 256), 1, 32))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.struct(F.col("turn").isNotNull().alias("numbered"), "turn", role.alias("role"), turn_id.alias("id"),
                 word_count(F.col("text")).alias("words")).alias("row"))
    return turns.groupBy("conv_id").agg(F.transform(
        F.array_sort(F.collect_list("row")), lambda t: F.struct(t["id"], t["words"])).alias("turns"))


def rebuilt(sequences, family=FAMILY, heads=HEADS):
    """Conversations that begin with up to ``heads - 1`` turns of the first of their family.

    Conversation c takes its first crc32(c) % heads turns from c - c % family, where
    there is one, and its own turns after as many.
    """
    none = F.array().cast(TURNS)
    first = sequences.where(F.col("conv_id") % family == 0).select(
        F.col("conv_id").alias("base"), F.slice("turns", 1, heads - 1).alias("first"))
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    return (
        sequences.withColumn("base", F.col("conv_id") - F.col("conv_id") % family).join(first, "base", "left")
        .select("conv_id", F.concat(
            F.slice(F.coalesce("first", none), F.lit(1), taken),
            F.slice("turns", taken + 1, F.size("turns") + 1)).alias("turns"))
    )


def _with_keys(sequences):
    """The chained hash and the words of every prefix; ``key`` is that of the whole sequence."""
    def chain(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                key, keys = ROOT, []
                for turn in row["turns"]:
                    key = hashlib.blake2b(key + turn["id"], digest_size=16).digest()
                    keys.append(key)
                out.append({"conv_id": row["conv_id"], "key": key, "keys": keys,
                            "words": [turn["words"] for turn in row["turns"]]})
            yield pa.RecordBatch.from_pylist(out, pa.schema([
                ("conv_id", pa.int64()), ("key", pa.binary()), ("keys", pa.list_(pa.binary())),
                ("words", pa.list_(pa.int64()))]))

    return sequences.mapInArrow(chain, SEQUENCES)


def _heads(sequences, most, step=FIRST_STEP):
    """(key, depth, words, parent) of all prefixes that more than ``most`` sequences share, but the root."""
    going, depth, found = sequences.select("keys", "words"), 0, []
    while True:
        prefixes = going.select(
            F.posexplode(F.arrays_zip(
                F.slice("keys", depth + 1, step).alias("key"), F.slice("words", depth + 1, step).alias("words"),
                F.slice(F.concat(F.array(F.lit(ROOT)), "keys"), depth + 1, step).alias("parent")))
        ).where(F.col("col.key").isNotNull())
        shared = stored(
            prefixes.groupBy("col.key", (F.col("pos") + depth + 1).cast("bigint").alias("depth"))
            .agg(F.count("*").alias("n"), F.min("col.words").alias("words"), F.min("col.parent").alias("parent"))
            .where(F.col("n") > most).drop("n"), "trie-heads")
        found.append(shared)
        depth += step
        deepest = shared.where(F.col("depth") == depth).select(F.col("key").alias("at"))
        if deepest.isEmpty():
            break
        going = stored(going.join(deepest, F.get("keys", F.lit(depth - 1)) == F.col("at"), "left_semi"), "trie-open")
        step *= 2
    heads = found[0]
    for more in found[1:]:
        heads = heads.unionByName(more)
    return heads


def _below_heads(sequences, heads):
    """Add ``above``, the number of turns that are heads of the trie."""
    deepest = heads.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    if not deepest:
        return sequences.withColumn("above", F.lit(0))
    on = sequences.select("key", F.posexplode(F.slice("keys", 1, deepest)).alias("at", "prefix")).join(
        heads.select(F.col("key").alias("prefix")), "prefix").groupBy("key").agg((F.max("at") + 1).alias("above"))
    return sequences.join(on, "key", "left").withColumn("above", F.coalesce("above", F.lit(0)))


class Node:
    """A node on the path that the sweep is at."""

    __slots__ = ("key", "words", "conv_id", "n", "leaves", "saved", "children")

    def __init__(self, key, words):
        self.key, self.words = key, words
        self.conv_id, self.n, self.leaves, self.saved, self.children = None, 0, 0, 0, []

    def meet(self, conv_id, n):
        self.conv_id = conv_id if self.conv_id is None else min(self.conv_id, conv_id)
        self.n += n

    def close(self, depth):
        """The rows of its children, and its own row but for the parent."""
        self.saved += (self.n - 1) * self.words
        self.leaves = self.leaves or 1
        rows = [child | {"parent_conv_id": self.conv_id} for child in self.children]
        return rows, {"key": self.key, "conv_id": self.conv_id, "depth": depth, "parent_conv_id": None,
                      "n_convs": self.n, "n_children": len(self.children), "n_leaves": self.leaves,
                      "saved_tokens": self.saved, "path": None}


def sweep(rows):
    """The nodes of containers whose sequences come in order.

    Rows have conv_id (the least of its conversations), n, keys, words, above. The
    topmost node of a container has ``path``, the keys of the heads above it.
    """
    stack, above, path = [], 0, []

    def close_to(length):
        while len(stack) > length:
            node = stack.pop()
            rows, own = node.close(above + len(stack) + 1)
            yield from rows
            if stack:
                top = stack[-1]
                top.meet(node.conv_id, node.n)
                top.leaves += node.leaves
                top.saved += node.saved
                top.children.append(own)
            else:
                yield own | {"path": path}

    for row in rows:
        keys, start = row["keys"], row["above"]
        shared = 0
        if stack and above == start and stack[0].key == keys[start]:
            while shared < len(stack) and start + shared < len(keys) and stack[shared].key == keys[start + shared]:
                shared += 1
        yield from close_to(shared)
        if not stack:
            above, path = start, [ROOT, *keys[:start]]
        for at in range(start + shared, len(keys)):
            stack.append(Node(keys[at], row["words"][at]))
        stack[-1].meet(row["conv_id"], row["n"])
    yield from close_to(0)


def _swept(containers):
    def run(batches):
        def rows():
            for batch in batches:
                yield from batch.to_pylist()

        schema = pa.schema([(name, pa.int64()) for name in (
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")])
        schema = pa.schema([("key", pa.binary()), *schema, ("path", pa.list_(pa.binary()))])
        held = []
        for node in sweep(rows()):
            held.append(node)
            if len(held) == 10_000:
                yield pa.RecordBatch.from_pylist(held, schema)
                held = []
        yield pa.RecordBatch.from_pylist(held, schema)

    in_order = containers.withColumn("container", F.get("keys", F.col("above"))).repartition(
        "container").sortWithinPartitions("container", "keys").drop("container")
    return in_order.mapInArrow(run, NODES)


def _ends(members):
    """key and ends_sha256 of (key, conv_id): the hash of a key's ids in order, joined by commas."""
    def texts(batches):
        key = first = None
        ids, size = [], 0

        def chunk():
            return pa.RecordBatch.from_pylist(
                [{"key": key, "first": first, "text": ",".join(ids)}],
                pa.schema([("key", pa.binary()), ("first", pa.int64()), ("text", pa.string())]))

        for batch in batches:
            for row in batch.to_pylist():
                if ids and (row["key"] != key or size >= CHUNK):
                    yield chunk()
                    ids, size = [], 0
                if not ids:
                    key, first = row["key"], row["conv_id"]
                ids.append(str(row["conv_id"]))
                size += len(ids[-1]) + 1
        if ids:
            yield chunk()

    def digests(batches):
        key, state = None, None
        schema = pa.schema([("key", pa.binary()), ("ends_sha256", pa.string())])
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["key"] != key:
                    if state is not None:
                        out.append({"key": key, "ends_sha256": state.hexdigest()})
                    key, state = row["key"], hashlib.sha256(row["text"].encode())
                else:
                    state.update(b"," + row["text"].encode())
            yield pa.RecordBatch.from_pylist(out, schema)
        if state is not None:
            yield pa.RecordBatch.from_pylist([{"key": key, "ends_sha256": state.hexdigest()}], schema)

    chunks = members.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(
        texts, "key binary, first bigint, text string")
    return chunks.repartition("key").sortWithinPartitions("key", "first").mapInArrow(
        digests, "key binary, ends_sha256 string")


def _summed_heads(heads, tops, ends, sequences):
    """The nodes of all heads, from the containers and the sequences that end right below them.

    ``tops`` has the topmost nodes of containers, ``ends`` sequences that are heads
    themselves; both have ``path``.
    """
    below = tops.select(
        F.explode("path").alias("key"), F.element_at("path", -1).alias("last"), "conv_id", "n_convs", "n_leaves",
        "saved_tokens", F.lit(1).alias("child"))
    at = ends.select(
        F.explode("path").alias("key"), F.lit(None).cast("binary").alias("last"), "conv_id",
        F.col("n").alias("n_convs"), F.lit(0).alias("n_leaves"), F.lit(0).alias("saved_tokens"), F.lit(0).alias("child"))
    sums = below.unionByName(at).groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_leaves").alias("n_leaves"),
        F.sum("saved_tokens").alias("saved_below"), F.count_if(F.col("last") == F.col("key")).alias("containers"))
    known = heads.unionByName(heads.sparkSession.createDataFrame(
        [(bytearray(ROOT), 0, 0, None)], "key binary, depth bigint, words bigint, parent binary"))
    sums = stored(sums.join(known, "key"), "trie-head-sums")
    # a head's own saving counts for all heads above it
    own = sums.select("conv_id", "depth", ((F.col("n_convs") - 1) * F.col("words")).alias("own")).where("own > 0")
    upwards = own.join(sequences.select("conv_id", "keys"), "conv_id").select(
        F.explode(F.concat(F.array(F.lit(ROOT)), F.slice("keys", F.lit(1), F.col("depth").cast("int")))).alias("key"),
        "own").groupBy("key").agg(F.sum("own").alias("own"))
    children = sums.groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("heads"))
    parents = sums.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    n_children = F.col("containers") + F.coalesce("heads", F.lit(0))
    return (
        sums.join(upwards, "key", "left").join(children, "key", "left").join(parents, "parent", "left")
        .select("key", "conv_id", "depth", "parent_conv_id", "n_convs", n_children.alias("n_children"),
                F.when(n_children == 0, F.lit(1)).otherwise(F.col("n_leaves")).cast("bigint").alias("n_leaves"),
                (F.col("saved_below") + F.coalesce("own", F.lit(0))).alias("saved_tokens"))
    )


def prefix_trie(sequences, container=CONTAINER):
    """The nodes of the trie of (conv_id, turns).

    Returns key (the prefix's hash, empty for the root), conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    named = stored(_with_keys(sequences), "trie-sequences")
    # equal conversations become one row before they are shuffled
    merged = stored(named.groupBy("key", "keys", "words").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n")), "trie-merged")
    heads = _heads(merged, container)
    placed = stored(_below_heads(merged, heads), "trie-placed")
    inside = F.size("keys") > F.col("above")
    nodes = stored(_swept(placed.where(inside).select("conv_id", "n", "keys", "words", "above")), "trie-nodes")
    tops = nodes.where(F.col("path").isNotNull())
    at_heads = placed.where(~inside).select(
        "conv_id", "n", F.concat(F.array(F.lit(ROOT)), "keys").alias("path"))
    upper = stored(_summed_heads(heads, tops, at_heads, merged), "trie-upper")
    parents = upper.select(F.col("key").alias("over"), F.col("conv_id").alias("top_parent"))
    lower = nodes.withColumn("over", F.element_at("path", -1)).join(parents, "over", "left").withColumn(
        "parent_conv_id", F.coalesce("parent_conv_id", "top_parent"))
    columns = upper.columns
    nothing = hashlib.sha256(b"").hexdigest()
    return lower.select(*columns).unionByName(upper).join(
        _ends(named.select("key", "conv_id")), "key", "left").select(
        *columns, F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))
