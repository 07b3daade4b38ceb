"""Repeated passages of documents, exact or slightly changed, by chains of shared k-mers.

1. Seeds: of every window of word k-mers the ones with the least hash. Equal passages
   have equal seeds, about one word in nine is one. Two neighbouring seeds of a document
   together are a seed as well, which stays telling where single k-mers are common. For
   changed passages, half of all spaced runs are seeds, too: six words with gaps that let a
   changed word pass, drawn by their hash alone, so that words around them do not matter.
2. A seed found in several documents meets its first occurrence (smallest id and place),
   so the pairs grow with the occurrences, not with their square. A passage whose seeds
   point to several documents is found again from any one of them by step 4.
3. The matches of a pair of documents are chained: a chain moves forward in both, a gap
   costs in proportion to its length on both sides, and the best predecessor comes from
   a Fenwick tree of prefix maxima over the other document's places. Chains are parted
   at gaps of more than ``MOST_GAP`` words.
4. Chains are aligned: between anchors words are compared along the diagonal, gaps of
   unequal length by edit distance, and both ends are extended while words agree. For
   that, each document is read once more and gives the ranges of words asked of it, as
   hashes; a range that many chains ask for is given once.
5. Of a chain that is too short or agrees too little as a whole, the longest stretches that
   agree enough are taken, with up to ``MARGIN`` words on both sides, so that a block inserted
   or replaced between two passages hides neither, and changed words near an end hide nothing.

A passage is reported for the later document if it has ``MIN_WORDS`` words or more there
and ``IDENTITY`` of them agree. Stretches of one chain may overlap. A passage that several earlier documents have is reported
for each of them that the seeds point to.

Null and empty texts have no passages; null ids take no part. Rows that repeat an id are
one document: of rows with different texts the greatest text counts. Repeats within one
document are not reported. An empty table gives an empty result.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..session import stored
from . import texts

KMER = 6
SEED_WINDOW = 16
MIN_WORDS = 50
IDENTITY = 0.8
GAP_COST = 0.15
MOST_GAP = 60
ANCHOR = 2
MARGIN = MIN_WORDS - ANCHOR
DROP = 6
SPACED = (0, 1, 3, 5, 6, 8)
SPACED_SHARE = 0.5

PASSAGES = ("doc_id bigint, start bigint, n_words bigint, from_doc_id bigint, from_start bigint, "
            "from_n_words bigint, n_equal bigint")


def _sliding(values, width, best):
    """Minimum or maximum of every window of ``width`` values."""
    span = 1
    while span * 2 <= width:
        values = best(values[:-span], values[span:]) if len(values) > span else values[:0]
        span *= 2
    rest = width - span
    return best(values[:len(values) - rest], values[rest:]) if rest else values


def seeds_of(hashes, owners, k=KMER, window=SEED_WINDOW):
    """K-mer hashes and word numbers of the seeds of the texts of a slice.

    A k-mer is a seed if it is the least of some window of k-mers of its text, ties
    included; a text with fewer k-mers than a window is one window.
    """
    values, first = texts.runs_of(hashes, owners, k)
    if not len(values):
        return values, first
    owner = owners[first]
    chosen = np.zeros(len(values), bool)
    if len(values) >= window:
        least = _sliding(values, window, np.minimum)
        whole = owner[:len(least)] == owner[window - 1:]
        # windows over two texts choose nothing
        bound = np.where(whole, least, 0)
        padded = np.concatenate((np.zeros(window - 1, np.uint64), bound, np.zeros(window - 1, np.uint64)))
        chosen = _sliding(padded, window, np.maximum) == values
    edges = np.flatnonzero(np.diff(owner)) + 1
    begin, end = np.concatenate(([0], edges)), np.concatenate((edges, [len(owner)]))
    for b, e in zip(begin[end - begin < window].tolist(), end[end - begin < window].tolist()):
        chosen[b:e] = values[b:e] == values[b:e].min()
    return values[chosen], first[chosen]


def spaced_seeds_of(hashes, owners, offsets=SPACED, share=SPACED_SHARE):
    """Hashes and first word numbers of the spaced runs that are drawn: words at ``offsets`` from the first."""
    size = len(hashes) - offsets[-1]
    if size <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(size, np.uint64)
    factor = 3
    for offset in offsets:
        total += hashes[offset:offset + size] * np.uint64(factor)
        factor = factor * texts.BASE % (1 << 64)
    values = texts.mix(total)
    drawn = np.flatnonzero((values < np.uint64(int(share * (1 << 64)))) & (owners[:size] == owners[offsets[-1]:]))
    return values[drawn], drawn


def seeds(documents, k=KMER, window=SEED_WINDOW, min_words=MIN_WORDS):
    """(seed, doc_id, at) of every document of at least ``min_words`` words; at counts words.

    Seeds are single k-mers, pairs of neighbours, placed at their first k-mer, and spaced runs. Equal
    seeds have at least ``ANCHOR`` equal words at their place.
    """
    def find(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for start, data, offsets in texts.slices(batch.column(1)):
                begins, ends, owners = texts.words(data, offsets)
                first, last = texts.group_bounds(owners, len(offsets) - 1)
                hashes = texts.word_hashes(data, begins, ends)
                values, at = seeds_of(hashes, owners, k, window)
                pairs, where = texts.runs_of(values, owners[at], 2)
                spaced, spaced_at = spaced_seeds_of(hashes, owners)
                values, at = np.concatenate((values, pairs, spaced)), np.concatenate((at, at[where], spaced_at))
                owner = owners[at]
                keep = (last - first)[owner] >= min_words
                owner, values, places = owner[keep], values[keep], (at - first[owner])[keep]
                yield pa.RecordBatch.from_pydict({
                    "seed": pa.array(values.view(np.int64)), "doc_id": pa.array(ids[start + owner], pa.int64()),
                    "at": pa.array(places.astype(np.int32))})

    return documents.select("doc_id", "text").mapInArrow(texts.released(find), "seed bigint, doc_id bigint, at int")


def matches(found):
    """(doc_id, at, from_doc_id, from_at) for seeds and their earlier occurrences in other documents."""
    def meet(batches):
        seed, first_doc, first_at = None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            values, docs, at = (batch.column(c).to_numpy() for c in ("seed", "doc_id", "at"))
            new = np.concatenate(([True], values[1:] != values[:-1]))
            begin = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            docs_first, at_first = docs[begin], at[begin]
            if values[0] == seed:  # goes on from the batch before
                docs_first, at_first = np.where(begin, docs_first, first_doc), np.where(begin, at_first, first_at)
            seed, first_doc, first_at = values[-1], docs_first[-1], at_first[-1]
            later = np.flatnonzero(docs > docs_first)
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(docs[later], pa.int64()), "at": pa.array(at[later], pa.int32()),
                "from_doc_id": pa.array(docs_first[later], pa.int64()),
                "from_at": pa.array(at_first[later], pa.int32())})

    # rows of a seed come in order, so one shuffle is enough and none of them is held
    return found.repartition("seed").sortWithinPartitions("seed", "doc_id", "at").mapInArrow(
        texts.released(meet), "doc_id bigint, at int, from_doc_id bigint, from_at int")


class PrefixMaxima:
    """A Fenwick tree: the best (value, number) at places up to a given one."""

    def __init__(self, size):
        self.best = [(-1.0, -1)] * (size + 1)

    def put(self, place, value, number):
        place += 1
        entry = (value, number)
        while place < len(self.best):
            if self.best[place] < entry:
                self.best[place] = entry
            place += place & -place

    def up_to(self, place):
        found = (-1.0, -1)
        while place > 0:
            if self.best[place] > found:
                found = self.best[place]
            place -= place & -place
        return found


def chained(at, other, k=KMER, gap_cost=GAP_COST, most_gap=MOST_GAP):
    """Chains of matches, as lists of match numbers, best first; every match is in one chain at most.

    ``at`` ascends. A chain's score is its matched words less the cost of its gaps; it is
    parted at gaps of more than ``most_gap`` words on either side.
    """
    n = len(at)
    if n == 1:
        return [[0]]
    if all(at[m] < at[m + 1] and other[m] < other[m + 1] for m in range(n - 1)):
        return _parted(at, other, *_rising(at, other, k, gap_cost), most_gap)
    ranks = {place: i for i, place in enumerate(sorted(set(other)))}
    tree = PrefixMaxima(len(ranks))
    score, before = [0.0] * n, [-1] * n
    offset = gap_cost * (at[0] + min(other)) if n else 0
    i = 0
    while i < n:
        j = i
        while j < n and at[j] == at[i]:  # matches of one place do not follow each other
            value, previous = tree.up_to(ranks[other[j]])
            score[j] = k
            if previous >= 0:
                added = min(k, at[j] - at[previous], other[j] - other[previous])
                gained = value - gap_cost * (at[j] + other[j]) + offset + added
                if gained > k:
                    score[j], before[j] = gained, previous
            j += 1
        for m in range(i, j):
            tree.put(ranks[other[m]], score[m] + gap_cost * (at[m] + other[m]) - offset, m)
        i = j
    return _parted(at, other, score, before, most_gap)


def _rising(at, other, k, gap_cost):
    """Scores and predecessors of matches that rise on both sides: all earlier ones are in the prefix."""
    offset = gap_cost * (at[0] + other[0])
    score, before = [], []
    best, previous = -1.0, -1
    for m, (p, q) in enumerate(zip(at, other)):
        own, link, way = float(k), -1, gap_cost * (p + q)
        if previous >= 0:
            gained = best - way + offset + min(k, p - at[previous], q - other[previous])
            if gained > k:
                own, link = gained, previous
        score.append(own)
        before.append(link)
        value = own + way - offset
        if value >= best:
            best, previous = value, m
    return score, before


def _parted(at, other, score, before, most_gap):
    """Chains by score and predecessor, parted at gaps of more than ``most_gap`` words."""
    n = len(at)
    used, out = [False] * n, []
    for m in sorted(range(n), key=lambda m: (-score[m], m)):
        chain = []
        while m >= 0 and not used[m]:
            used[m] = True
            chain.append(m)
            m = before[m]
        part = []
        for m in reversed(chain):
            if part and max(at[m] - at[part[-1]], other[m] - other[part[-1]]) > most_gap:
                out.append(part)
                part = []
            part.append(m)
        if part:
            out.append(part)
    return out


def chains(matched, k=KMER):
    """Chains of every pair of documents: the anchors' places in both."""
    def chain(batches):
        held = None

        def found(columns):
            docs, froms, at, other = columns
            new = np.concatenate(([True], (docs[1:] != docs[:-1]) | (froms[1:] != froms[:-1])))
            # by a k-mer and by a pair: once
            once = np.concatenate(([True], new[1:] | (at[1:] != at[:-1]) | (other[1:] != other[:-1])))
            begins = np.flatnonzero(new[once])
            docs, froms, at, other = docs[once], froms[once], at[once].tolist(), other[once].tolist()
            rows, numbers, places, from_places = [], [], [], []
            for begin, end in zip(begins.tolist(), [*begins[1:].tolist(), len(at)]):
                own, its = at[begin:end], other[begin:end]
                for number, members in enumerate(chained(own, its, k)):
                    rows.append(begin)
                    numbers.append(number)
                    places.append([own[m] for m in members])
                    from_places.append([its[m] for m in members])
            return pa.RecordBatch.from_pydict({
                "doc_id": pa.array(docs[rows], pa.int64()), "from_doc_id": pa.array(froms[rows], pa.int64()),
                "number": pa.array(numbers, pa.int32()), "at": pa.array(places, pa.list_(pa.int32())),
                "from_at": pa.array(from_places, pa.list_(pa.int32()))})

        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in ("doc_id", "from_doc_id", "at", "from_at")]
            if held is not None:
                columns = [np.concatenate(pair) for pair in zip(held, columns)]
            if not len(columns[0]):
                continue
            # the last pair may go on in the next batch
            last = np.flatnonzero((columns[0] != columns[0][-1]) | (columns[1] != columns[1][-1]))
            whole = int(last[-1]) + 1 if len(last) else 0
            held = [c[whole:] for c in columns]
            if whole:
                yield found([c[:whole] for c in columns])
        if held is not None and len(held[0]):
            yield found(held)

    return (
        matched.select("doc_id", "from_doc_id", "at", "from_at")
        .repartition("doc_id", "from_doc_id").sortWithinPartitions("doc_id", "from_doc_id", "at", "from_at")
        .mapInArrow(texts.released(chain),
                    "doc_id bigint, from_doc_id bigint, number int, at array<int>, from_at array<int>")
    )


def _ranges(documents, asked):
    """Word hashes of the asked ranges (doc_id, low, high) of the documents: adds words."""
    per_document = asked.distinct().withColumn("turn", F.pmod(F.xxhash64("low", "high"), F.lit(8))).groupBy(
        "doc_id", "turn").agg(F.collect_list(F.struct("low", "high")).alias("asked"))
    one_text = documents.where("doc_id IS NOT NULL").select("doc_id", "text")

    def cut(batches):
        for batch in batches:
            ids, lists = batch.column("doc_id"), batch.column("asked").to_pylist()
            for start, data, offsets in texts.slices(batch.column("text")):
                begins, ends, owners = texts.words(data, offsets)
                hashes = texts.word_hashes(data, begins, ends).astype(np.uint32)
                first, last = texts.group_bounds(owners, len(offsets) - 1)
                rows, low, high, words = [], [], [], []
                for i, (b, e) in enumerate(zip(first.tolist(), last.tolist())):
                    for r in lists[start + i]:
                        rows.append(start + i)
                        low.append(r["low"])
                        high.append(r["high"])
                        words.append(hashes[b + max(0, r["low"]):min(e, b + r["high"])].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(rows, pa.int64())), pa.array(low, pa.int32()), pa.array(high, pa.int32()),
                     pa.array(words, pa.binary())], ["doc_id", "low", "high", "words"])

    return one_text.join(per_document, "doc_id").select("doc_id", "text", "asked").mapInArrow(
        texts.released(cut), "doc_id bigint, low int, high int, words binary")


def _edit_matches(x, y):
    """Length of a longest common subsequence of two short lists."""
    row = [0] * (len(y) + 1)
    for a in x:
        corner = 0
        for j, b in enumerate(y, 1):
            corner, row[j] = row[j], corner + 1 if a == b else max(row[j], row[j - 1])
    return row[-1]


def _extensions(equal, there, drop=DROP):
    """Words to add at an end of each chain, and how many of them agree.

    As far as agreement outweighs difference: ``equal`` says for every chain whether the
    words at each step from its end agree, ``there`` whether both texts have that step.
    """
    score = np.cumsum(np.where(equal, 1, -1), axis=1)
    score = np.where(there, score, -len(score[0]) - 1)
    fallen = np.maximum(np.maximum.accumulate(score, axis=1), 0) - score >= drop
    stopped = np.cumsum(fallen, axis=1) - fallen > 0
    score = np.where(stopped, -len(score[0]) - 1, score)
    best = np.argmax(score, axis=1)
    row = np.arange(len(best))
    extends = score[row, best] > 0
    agree = np.cumsum(equal, axis=1)[row, best]
    return np.where(extends, best + 1, 0), np.where(extends, agree, 0)


def _between(at, other, x, y, k):
    """Words that agree from the first anchor of a chain to the end of its last one; x and y begin at the first."""
    if all(p - s == at[0] - other[0] for p, s in zip(at, other)):
        return k + int((x[k:] == y[k:]).sum())
    equal = k
    for p, q, s, t in zip(at, at[1:], other, other[1:]):
        a, b = x[p + k - at[0]:q + k - at[0]], y[s + k - other[0]:t + k - other[0]]
        if len(a) == len(b):
            equal += int((a == b).sum())
        else:
            equal += min(_edit_matches(a.tolist(), b.tolist()), len(a), len(b))
    return equal


def _agreeing(x, y):
    """Places of a longest common subsequence of two short arrays, in both."""
    table = np.zeros((len(x) + 1, len(y) + 1), np.int32)
    for i, a in enumerate(x, 1):
        table[i, 1:] = np.maximum(table[i - 1, 1:], table[i - 1, :-1] + (y == a))
        np.maximum.accumulate(table[i], out=table[i])
    found, i, j = [], len(x), len(y)
    while i and j:
        if table[i, j] == table[i - 1, j]:
            i -= 1
        elif table[i, j] == table[i, j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            found.append((i, j))
    return np.array(found[::-1], np.int64).reshape(-1, 2).T


def _agreements(at, other, x, y, before, k):
    """Places in x and y of the words that agree; x and y have ``before`` words in front of the first anchor."""
    parts = []
    bounds = [(before, before), *((p + k - at[0] + before, s + k - other[0] + before) for p, s in zip(at, other)),
              (len(x), len(y))]
    own = its = 0
    for i, j in bounds:
        a, b = x[own:i], y[its:j]
        if len(a) == len(b):
            same = np.flatnonzero(a == b)
            parts.append((own + same, its + same))
        else:
            same = _agreeing(a, b)
            parts.append((own + same[0], its + same[1]))
        own, its = i, j
    return (np.concatenate(side) for side in zip(*parts))


def stretches(own, its, min_words, identity):
    """(first, last) numbers of agreeing words of the stretches that hold every stretch agreeing enough.

    ``own`` and ``its`` are the words' places. A longest stretch begins and ends with a run of
    agreeing words, as more of the run would only make it agree more. Of the longest ones,
    as few are given as hold all words of them.
    """
    if not len(own):
        return []
    edges = np.flatnonzero((np.diff(own) != 1) | (np.diff(its) != 1))
    begins, ends = np.concatenate(([0], edges + 1)), np.concatenate((edges, [len(own) - 1]))
    longest = []
    for first in range(0, len(begins), 256):
        begin = begins[first:first + 256, None]
        length, other_length = own[ends] + 1 - own[begin], its[ends] + 1 - its[begin]
        good = (length >= min_words) & (ends + 1 - begin >= identity * np.maximum(length, other_length))
        for row in np.flatnonzero(good.any(axis=1)).tolist():
            last = int(ends[np.flatnonzero(good[row])[-1]])
            if not longest or last > longest[-1][1]:
                longest.append((int(begin[row, 0]), last))
    chosen = []
    for i, (begin, last) in enumerate(longest):
        # the one before and the one after leave nothing to it
        if chosen and i + 1 < len(longest) and longest[i + 1][0] <= chosen[-1][1] + 1:
            continue
        chosen.append((begin, last))
    return chosen


def _bounds(column):
    offsets = np.frombuffer(column.buffers()[1], np.int32)
    return offsets[column.offset:column.offset + len(column) + 1].astype(np.int64)


def aligned(batch, k=ANCHOR, min_words=MIN_WORDS, identity=IDENTITY, margin=MARGIN):
    """The passages of a batch of chains: columns as in ``PASSAGES`` but for the ids, and their row numbers.

    A chain is one passage if it is long and agrees enough, and otherwise its ``stretches`` are. Each
    anchor has ``k`` equal words.

    A row has the anchors' places ``at`` and ``from_at``, and the words around them, of which
    the first is at ``low`` and ``from_low``.
    """
    sides = []
    for places, low, words in (("at", "low", "words"), ("from_at", "from_low", "from_words")):
        anchors, column = batch.column(places), batch.column(words)
        edges, bounds = _bounds(anchors), _bounds(column) // 4
        values = anchors.values.to_numpy()
        data = column.buffers()[2]
        data = np.frombuffer(data, np.uint32, bounds[-1]) if data else np.zeros(0, np.uint32)
        first, last = values[edges[:-1]].astype(np.int64), values[edges[1:] - 1].astype(np.int64)
        begin = bounds[:-1] + first - np.maximum(0, batch.column(low).to_numpy())
        sides.append((values, edges, data, bounds, first, last, begin, begin + last - first + k))
    (at, edges, x, x_bounds, first, last, x_begin, x_end) = sides[0]
    (other, other_edges, y, y_bounds, other_first, other_last, y_begin, y_end) = sides[1]
    step = np.arange(margin)

    def compare(x_places, y_places, room):
        there = step < room[:, None]
        words = [d[np.clip(places, 0, len(d) - 1)] for d, places in ((x, x_places), (y, y_places))]
        equal = (words[0] == words[1]) & there
        return *_extensions(equal, there), equal.sum(axis=1)

    room = np.minimum(x_begin - x_bounds[:-1], y_begin - y_bounds[:-1])
    room_after = np.minimum(x_bounds[1:] - x_end, y_bounds[1:] - y_end)
    before, agree, most = compare((x_begin - 1)[:, None] - step, (y_begin - 1)[:, None] - step, room)
    after, agree_after, most_after = compare(x_end[:, None] + step, y_end[:, None] + step, room_after)
    length, other_length = x_end - x_begin + before + after, y_end - y_begin + before + after
    equal = k + agree + agree_after
    rows = np.flatnonzero(length >= min_words)
    for i in rows[edges[1:][rows] - edges[:-1][rows] > 1].tolist():
        equal[i] += _between(at[edges[i]:edges[i + 1]].tolist(), other[other_edges[i]:other_edges[i + 1]].tolist(),
                             x[x_begin[i]:x_end[i]], y[y_begin[i]:y_end[i]], k) - k
    rows = rows[equal[rows] >= identity * np.maximum(length, other_length)[rows]]
    # the others, if words enough can agree
    most = most + most_after + np.minimum(x_end - x_begin, y_end - y_begin)
    parted = np.setdiff1d(np.flatnonzero(most >= identity * min_words), rows)
    columns = [c[rows] for c in (first - before, length, other_first - before, other_length, equal)]
    found = []
    for i in parted.tolist():
        lead, tail = min(margin, int(room[i])), min(margin, int(room_after[i]))
        own, its = _agreements(
            at[edges[i]:edges[i + 1]].tolist(), other[other_edges[i]:other_edges[i + 1]].tolist(),
            x[x_begin[i] - lead:x_end[i] + tail], y[y_begin[i] - lead:y_end[i] + tail], lead, k)
        for b, e in stretches(own, its, min_words, identity):
            found.append((i, first[i] - lead + own[b], own[e] + 1 - own[b], other_first[i] - lead + its[b],
                          its[e] + 1 - its[b], e + 1 - b))
    found = np.array(found, np.int64).reshape(-1, 6).T
    return np.concatenate((rows, found[0])), [np.concatenate(c) for c in zip(columns, found[1:])]


def repeated_passages(documents, min_words=MIN_WORDS, identity=IDENTITY, k=KMER, window=SEED_WINDOW):
    """Passages of (doc_id, text) that an earlier document has as well: see ``PASSAGES``; places count words.

    ``made_from`` of the result are stored tables, to be discarded once it is stored itself.
    """
    usable = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select(
        F.col("doc_id").cast("bigint"), "text")
    linked = chains(matches(seeds(usable, k, window, min_words)), k)
    margin = max(MARGIN, min_words - ANCHOR)
    reach = margin + ANCHOR
    span = lambda c: (F.element_at(c, 1) - F.lit(margin), F.element_at(c, -1) + F.lit(reach))
    (low, high), (from_low, from_high) = span("at"), span("from_at")
    # what a chain can reach at most must be long enough
    linked = stored(
        linked.withColumns({"low": low, "high": high, "from_low": from_low, "from_high": from_high})
        .where(F.least(F.col("high") - F.col("low"), F.col("from_high") - F.col("from_low")) >= min_words), "chains")
    asked = linked.select("doc_id", "low", "high").unionByName(
        linked.select(F.col("from_doc_id").alias("doc_id"), F.col("from_low").alias("low"),
                      F.col("from_high").alias("high")))
    ranges = stored(_ranges(usable, asked), "ranges")
    one = ranges.groupBy("doc_id", "low", "high").agg(F.max("words").alias("words"))
    both = linked.join(one, ["doc_id", "low", "high"]).join(
        one.withColumnsRenamed({"doc_id": "from_doc_id", "low": "from_low", "high": "from_high",
                                "words": "from_words"}), ["from_doc_id", "from_low", "from_high"])

    def align(batches):
        names = PASSAGES.replace(" bigint", "").split(", ")
        for batch in batches:
            if batch.num_rows:
                rows, (start, n_words, from_start, from_n_words, n_equal) = aligned(batch, ANCHOR, min_words, identity, margin)
                ids, from_ids = (batch.column(c).take(pa.array(rows)) for c in ("doc_id", "from_doc_id"))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(start), pa.array(n_words), from_ids, pa.array(from_start), pa.array(from_n_words),
                     pa.array(n_equal)], names)

    passages = both.select(
        "doc_id", "from_doc_id", "at", "from_at", "low", "from_low", "words", "from_words"
    ).mapInArrow(texts.released(align), PASSAGES).distinct()  # two chains can reach the same words
    passages.made_from = linked, ranges
    return passages


def without_passages(documents, passages):
    """The documents without the words of their passages; the other text stays as it is.

    Documents that lose every word go. Keeps the columns of ``documents``; ``n_chars``,
    if there, is counted anew.
    """
    spans = passages.groupBy("doc_id", "start").agg(F.max("n_words").alias("n_words"))
    spans = spans.groupBy(F.col("doc_id").alias("of")).agg(
        F.array_sort(F.collect_list(F.struct("start", "n_words"))).alias("spans"))
    names = documents.columns
    rows = documents.select(F.struct(*names).alias("row"))
    joined = rows.join(spans, F.col("row.doc_id") == F.col("of"), "left").select("row", "spans")

    def cut(batches):
        for batch in batches:
            columns = {name: batch.column("row").field(i) for i, name in enumerate(names)}
            lists, out = batch.column("spans").to_pylist(), columns["text"].to_pylist()
            touched = [i for i, found in enumerate(lists) if found and out[i] is not None]
            keep = np.ones(batch.num_rows, bool)
            for i in touched:
                raw = out[i].encode()
                data = np.frombuffer(raw, np.uint8)
                begins, ends, _ = texts.words(data, np.array([0, len(data)]))
                parts, place = [], 0
                for span in lists[i]:
                    first, last = span["start"], min(span["start"] + span["n_words"], len(begins))
                    if last > first and ends[last - 1] > place:
                        parts.append(raw[place:max(place, int(begins[first]))])
                        place = int(ends[last - 1])
                parts.append(raw[place:])
                out[i] = b"".join(parts).decode()
                keep[i] = bool(out[i].strip(" \t\n\v\f\r"))
            columns["text"] = pa.array(out, columns["text"].type)
            if "n_chars" in columns:
                counts = columns["n_chars"].to_pylist()
                for i in touched:
                    counts[i] = len(out[i])
                columns["n_chars"] = pa.array(counts, columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names).filter(pa.array(keep))

    return joined.mapInArrow(texts.released(cut), documents.schema)
