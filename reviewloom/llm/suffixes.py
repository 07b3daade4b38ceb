"""Removal of long repeated byte strings by induced sorting of suffixes, cut off at their length.

A byte is removed if some string of ``length`` bytes that covers it also starts
elsewhere. That only asks which suffixes share their first ``length`` bytes with a
neighbour in sorted order, so suffixes are sorted up to that depth, and in three steps
of which each induces the next:

1. Sampled suffixes. Of every window of byte k-mers the ones with the least hash are
   sampled, so that equal strings of ``length`` bytes contain equal samples at equal
   places. Samples are named by their k-mer; a sample whose name occurs once belongs to
   no repeated string. A sample is settled if the string that reaches from the first to
   past the last window around it repeats as a whole: then all of those windows repeat.
2. Blocks of ``BLOCK`` neighbouring suffixes before each remaining sample. Their common
   part is the name they are sorted by; a block whose name occurs once is done.
3. Suffixes. The suffixes of a block are tuples of the bytes before and after the common
   part. They are sorted by what follows, and the order of the suffixes one byte earlier
   is induced from it by a stable sort on the byte before; common-prefix values of
   neighbours are carried along, and a suffix repeats if one reaches ``length``. Equal
   tuples are one tuple with a multiplicity, so copies are no work. Names with more than
   ``LARGE_NAME`` different tuples are counted by whole suffixes, which needs no group in
   one task.

The sorts and joins are Spark's, which spill to disk, so a shard may be far larger than
memory; what a task holds is a batch of tuples.

Null texts are empty. Rows that repeat an id are texts of their own, so repeated rows
repeat each other. An empty table gives an empty result. Names are 64-bit hashes.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..session import stored
from . import texts

LENGTH = 400
KMER = 100
BLOCK = 32
LARGE_NAME = 20_000

SAMPLES = "text_key binary, at bigint, name bigint, whole bigint"
BLOCKS = "name bigint, text_key binary, at bigint, before binary, after binary, n_before int, n_after int"


def _rolling(data, width):
    """Hashes of all parts of ``width`` bytes."""
    if len(data) < width:
        return np.zeros(0, np.uint64)
    sums = texts.prefix_hashes(data)
    starts = np.arange(len(data) - width + 1)
    return texts.part_hashes(sums, starts, starts + width)


def _window_least(values, width):
    """Minimum of each window, and the place of its first occurrence."""
    least, at = values, np.arange(len(values))
    span = 1

    def merge(shift):
        n = len(least) - shift
        right = least[shift:] < least[:n]
        return np.where(right, least[shift:], least[:n]), np.where(right, at[shift:], at[:n])

    while span * 2 <= width:
        least, at = merge(span)
        span *= 2
    if width > span:
        least, at = merge(width - span)
    return least, at


def samples_of(data, offsets, length=LENGTH, k=KMER):
    """The sample of every window of a slice of texts, and which windows lie in one text.

    The sample of a window of ``length`` bytes is the first least k-mer in it.
    """
    windows = max(0, len(data) - length + 1)
    owner, whole = np.empty(windows, np.int64), np.zeros(windows + 1, np.int64)
    for first in range(0, windows, texts.SLICE_BYTES):
        n = min(texts.SLICE_BYTES, windows - first)
        owner[first:first + n] = _window_least(_rolling(data[first:first + n + length - 1], k), length - k + 1)[1] + first
    begin, end = offsets[:-1], offsets[1:] - length + 1
    some = end > begin
    whole[begin[some]] += 1
    whole[end[some]] -= 1
    return owner, np.cumsum(whole[:-1]) > 0


def _part_hashes(data, starts, ends):
    """Hashes of many parts of a text, a bounded part of it at a time; starts ascend."""
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        begin = int(starts[first])
        last = max(first + 1, int(np.searchsorted(ends, begin + texts.SLICE_BYTES, "right")))
        sums = texts.prefix_hashes(data[begin:int(ends[last - 1])])
        out[first:last] = texts.part_hashes(sums, starts[first:last] - begin, ends[first:last] - begin)
        first = last
    return out


def _samples(whole_texts, length, k):
    """Samples of every text (text_key, text), with the name of the string around each, null at an end of the text."""
    reach = length - k

    def sample(batches):
        for batch in batches:
            keys = batch.column(0)
            for start, data, offsets in texts.slices(batch.column(1)):
                owner, inside = samples_of(data, offsets, length, k)
                at = owner[inside]
                at = at[np.concatenate((np.ones(min(1, len(at)), bool), at[1:] != at[:-1]))]
                text = np.searchsorted(offsets, at, "right") - 1
                surrounded = (at - reach >= offsets[text]) & (at + length <= offsets[text + 1])
                around = np.zeros(len(at), np.uint64)
                around[surrounded] = _part_hashes(data, at[surrounded] - reach, at[surrounded] + length)
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(start + text, pa.int64())), pa.array(at - offsets[text]),
                     pa.array(_part_hashes(data, at, at + k).view(np.int64)),
                     pa.array(around.view(np.int64), mask=~surrounded)],
                    ["text_key", "at", "name", "whole"])

    return whole_texts.mapInArrow(sample, SAMPLES)


def _blocks(chosen_texts, length, k):
    """Blocks before the chosen samples of (text_key, text, chosen): the windows whose sample is chosen."""
    shared = length - BLOCK + 1

    def cut(batches):
        for batch in batches:
            keys, lists = batch.column("text_key"), batch.column("chosen").to_pylist()
            for start, data, offsets in texts.slices(batch.column("text")):
                owner, inside = samples_of(data, offsets, length, k)
                chosen = np.zeros(len(data) + 1, bool)
                for i, begin in enumerate(offsets[:-1]):
                    chosen[begin + np.array(lists[start + i], np.int64)] = True
                windows = np.flatnonzero(inside & chosen[owner])
                # a block is named by its last window: the one that begins nearest to the sample
                back = owner[windows] - windows
                text = np.searchsorted(offsets, windows, "right") - 1
                at, first = np.unique(owner[windows] - back // BLOCK * BLOCK, return_index=True)
                text = text[first]
                fits = at + shared <= offsets[text + 1]
                at, text = at[fits], text[fits]
                names = _part_hashes(data, at, at + shared).view(np.int64)
                n_before = np.minimum(at - offsets[text], BLOCK - 1)
                n_after = np.minimum(offsets[text + 1] - at - shared, BLOCK - 1)
                raw = data.tobytes()
                yield pa.RecordBatch.from_pydict({
                    "name": pa.array(names), "text_key": keys.take(pa.array(start + text, pa.int64())),
                    "at": pa.array(at - offsets[text]),
                    "before": pa.array([raw[a - b:a] for a, b in zip(at.tolist(), n_before.tolist())], pa.binary()),
                    "after": pa.array([raw[a:a + b] for a, b in zip((at + shared).tolist(), n_after.tolist())],
                                      pa.binary()),
                    "n_before": pa.array(n_before.astype(np.int32)), "n_after": pa.array(n_after.astype(np.int32))})

    return chosen_texts.mapInArrow(cut, BLOCKS)


def _padded(column, from_end):
    """Byte strings of fewer than BLOCK bytes as rows of bytes; reversed if they are read from their end."""
    rows = np.zeros((len(column), BLOCK - 1), np.uint8)
    for i, value in enumerate(column):
        part = np.frombuffer(value, np.uint8)
        rows[i, :len(part)] = part[::-1] if from_end else part
    return rows


def induced_repeats(group, before, after, n_before, n_after, copies):
    """Which suffixes of the blocks of some groups repeat in their group, as a bit for each step back.

    Suffix t of a block starts t bytes before the common part and must reach
    BLOCK - 1 - t bytes past it.
    """
    n = len(group)
    keys = [after[:, c] for c in range(BLOCK - 2, -1, -1)]
    order = np.lexsort((*keys, group))
    # common prefix of neighbours in sorted order, beyond the common part
    bits = np.zeros(n, np.int64)
    label = group[order].astype(np.int64)
    for t in range(BLOCK):
        if t:
            # induce: a stable sort by the byte before keeps the order of what follows
            byte = before[order, t - 1].astype(np.int64)
            by = np.lexsort((byte, label))
            order, label, byte = order[by], label[by], byte[by]
            new = np.concatenate(([True], (label[1:] != label[:-1]) | (byte[1:] != byte[:-1])))
            label = np.cumsum(new)
        need = BLOCK - 1 - t
        valid = (n_before[order] >= t) & (n_after[order] >= need)
        # suffixes that end beyond their text are out; neighbours are those that remain
        there, own = order[valid], label[valid]
        bits[there[copies[there] > 1]] |= 1 << t
        if len(there) < 2:
            continue
        prefix = (after[there[1:], :need] == after[there[:-1], :need]).all(1) & (own[1:] == own[:-1])
        repeated = np.zeros(len(there), bool)
        repeated[1:] |= prefix
        repeated[:-1] |= prefix
        bits[there[repeated]] |= 1 << t
    return bits


def _induced(blocks):
    """(block, bits) of distinct blocks sorted by name; a batch ends where a name does."""
    def induce(batches):
        held = None

        def settle(table):
            name = table.column("name").combine_chunks().to_numpy(zero_copy_only=False)
            group = np.cumsum(np.concatenate(([True], name[1:] != name[:-1])))
            columns = {c: table.column(c).to_pylist() for c in ("before", "after")}
            bits = induced_repeats(
                group, _padded(columns["before"], True), _padded(columns["after"], False),
                *(table.column(c).combine_chunks().to_numpy(zero_copy_only=False)
                  for c in ("n_before", "n_after", "copies")))
            out = pa.table({"block": table.column("block"), "bits": pa.array(bits)})
            return out.filter(pa.array(bits != 0)).to_batches()

        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            name = held.column("name").combine_chunks().to_numpy(zero_copy_only=False)
            if not len(name):
                continue
            last = int(np.flatnonzero(name != name[-1]).max(initial=-1)) + 1  # names are sorted
            if last:
                yield from settle(held.slice(0, last))
                held = held.slice(last)
        if held is not None and len(held):
            yield from settle(held)

    return blocks.mapInArrow(induce, "block bigint, bits bigint")


def _counted(blocks):
    """As ``_induced``, for names with very many blocks: whole suffixes are counted."""
    need = F.lit(BLOCK - 1) - F.col("t")
    row = blocks.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(BLOCK - 1)))).where(
        (F.col("n_before") >= F.col("t")) & (F.col("n_after") >= need))
    row = row.select("block", "copies", "t", F.xxhash64(
        "name", "t", F.substring("before", F.col("n_before") - F.col("t") + 1, F.col("t")),
        F.substring("after", F.lit(1), need)).alias("suffix"))
    repeated = row.groupBy("suffix").agg(F.sum("copies").alias("n")).where("n > 1").select("suffix")
    return row.join(repeated, "suffix").groupBy("block").agg(
        F.sum(F.expr("shiftleft(1L, t)")).alias("bits"))


def repeated_windows(whole_texts, length=LENGTH, k=KMER):
    """Starts of repeated strings of texts (text_key, text): (text_key, at, bits).

    Bit t of a row says that the string that starts t bytes before ``at`` repeats; a row
    of null bits says so for every start from ``at`` on the next length - k + 1 bytes.
    """
    samples = stored(_samples(whole_texts, length, k), "samples")
    names = samples.groupBy("name").agg(F.count("*").alias("n_name")).where("n_name > 1").select("name")
    shared = stored(samples.join(names.hint("merge"), "name"), "shared-samples")
    wholes = shared.where("whole IS NOT NULL").groupBy("whole").agg(
        F.count("*").alias("n_whole"), F.min(F.struct("text_key", "at")).alias("witness")).where("n_whole > 1")
    judged = shared.join(wholes, "whole", "left").select(
        "text_key", "at", F.col("witness").isNotNull().alias("settled"),
        (F.col("witness").isNull() | (F.col("witness.text_key") == F.col("text_key"))
         & (F.col("witness.at") == F.col("at"))).alias("open"))
    judged = stored(judged, "judged-samples")
    # rows that are equal share a key, and each of their places is listed once
    per_text = judged.where("open").groupBy("text_key").agg(F.collect_set("at").alias("chosen"))
    chosen = whole_texts.join(per_text.hint("merge"), "text_key").select("text_key", "text", "chosen")
    blocks = stored(_blocks(chosen, length, k).withColumn("block", F.xxhash64("name", "before", "after")), "blocks")
    several = blocks.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name")
    distinct = stored(
        blocks.join(several.hint("merge"), "name").groupBy("name", "block").agg(
            *(F.first(c).alias(c) for c in ("before", "after", "n_before", "n_after")),
            F.count("*").alias("copies")), "distinct-blocks")
    sized = distinct.join(distinct.groupBy("name").agg(F.count("*").alias("n")).hint("merge"), "name")
    small = sized.where(F.col("n") <= LARGE_NAME).repartition("name").sortWithinPartitions("name")
    large = sized.where(F.col("n") > LARGE_NAME)
    repeated = stored(_induced(small).unionByName(_counted(large)), "repeated-blocks")
    repeated = blocks.select("block", "text_key", "at").join(repeated.hint("merge"), "block").drop("block")
    settled = judged.where("settled").select(
        "text_key", (F.col("at") - (length - k)).alias("at"), F.lit(None).cast("bigint").alias("bits"))
    return repeated.unionByName(settled)


def _spans(rows, length, k):
    """Sorted, disjoint spans of bytes that repeated strings of one text cover."""
    starts = []
    for at, bits in rows:
        if bits is None:
            starts.append((at, at + 2 * length - k))
            continue
        t = 0
        while bits >> t:
            if bits >> t & 1:
                last = t
                while bits >> (last + 1) & 1:
                    last += 1
                starts.append((at - last, at - t + length))
                t = last
            t += 1
    out = []
    for start, end in sorted(starts):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def _remaining(data, spans):
    parts, place = [], 0
    for start, end in spans:
        parts.append(data[place:start])
        place = end
    return [*parts, data[place:]]


def without_repeats(documents, length=LENGTH, k=KMER):
    """What each row of (doc_id, text) keeps: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, kept_text.

    ``kept_text`` has the remaining bytes as text; characters that were cut are left out.
    """
    keyed = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    named = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "text")
    keyed = keyed.withColumn("text_key", F.unhex(F.md5(named.cast("binary"))))
    found = repeated_windows(
        keyed.where(F.octet_length("text") >= length).select("text_key", "text"), length, k)
    per_text = stored(found.groupBy("text_key").agg(F.collect_set(F.struct("at", "bits")).alias("found")), "repeats")
    joined = keyed.join(per_text.hint("merge"), "text_key", "left").select("doc_id", "text", "found")

    def remove(batches):
        for batch in batches:
            found = batch.column("found")
            sizes, removed, counts, hashes, lists, kept = [], [], [], [], [], []
            for start, data, offsets in texts.slices(batch.column("text")):
                raw = data.tobytes()
                for i in range(len(offsets) - 1):
                    own = raw[offsets[i]:offsets[i + 1]]
                    rows = found[start + i].as_py() or []
                    spans = _spans([(r["at"], r["bits"]) for r in rows], length, k)
                    rest = b"".join(_remaining(own, spans))
                    sizes.append(len(own))
                    removed.append(sum(e - b for b, e in spans))
                    counts.append(len(spans))
                    hashes.append(hashlib.sha256(rest).hexdigest())
                    kept.append(rest.decode(errors="ignore"))
                    lists.append([{"start": b, "end": e} for b, e in spans])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(counts, pa.int64()), pa.array(hashes, pa.string()),
                 pa.array(lists, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                 pa.array(kept, pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept_text"])

    return joined.mapInArrow(
        remove, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, "
                "spans array<struct<start: bigint, end: bigint>>, kept_text string")
