"""Language by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary. The
probability of a word is the sum over all of its segmentations into pieces, which a
forward pass over the word gives; a text's is the product over its words. The piece
probabilities are fitted by expectation-maximisation on the word counts of labelled
texts: each round sums, over all segmentations, how often a piece is expected to be
used. A word is a maximal run of letters, read with a leading space.

The model has one row per piece of the vocabulary, however large the corpus. It is
fitted on a sample of about ``SAMPLE_TEXTS`` labelled texts per language, drawn by a
hash of the id; that is the only bound, prediction reads every whole text.

Null or letterless texts get ``und`` with score 0. Rows that repeat an id are
predicted one by one. Without labelled rows everything is ``und``. Words of more than
about ``LONGEST_WORD`` bytes are read as several, cut where a character begins; the
vocabulary's pieces are all used. Probabilities are carried times ``SCALE`` per byte, so
that a word of unseen bytes stays above 0.
"""

import base64

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored
from . import texts

SAMPLE_TEXTS = 3000
ROUNDS = 3
LONGEST_WORD = 40
SCALE = 2.0 ** 20
SMOOTHING = 0.5
UNKNOWN = "und"
KNOWN_WORDS = 400_000
_BLOCK = 4096


def vocabulary(name="byte_bpe_50k.tiktoken"):
    """All pieces of a public vocabulary; all single bytes are among them."""
    with open(public_tokenizers.path(name), "rb") as lines:
        pieces = {base64.b64decode(line.split()[0]) for line in lines}
    return sorted(pieces | {bytes([b]) for b in range(256)})


def scaled(pieces, probability):
    """Probabilities times ``SCALE`` per byte; the last row stands for what is no piece.

    A sum over segmentations of a word is then its probability times ``SCALE`` per byte
    of the word, and the factors cancel in shares of it. Pieces longer than any word
    meet none, so their factor only has to be finite.
    """
    sizes = np.minimum([len(p) for p in pieces], LONGEST_WORD + 4)
    return np.vstack([probability * SCALE ** sizes[:, None], np.zeros(probability.shape[1])])


class Pieces:
    """Piece numbers of every part of many words at once."""

    def __init__(self, pieces):
        joined = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum([len(p) for p in pieces])
        hashes = texts.part_hashes(texts.prefix_hashes(joined), np.concatenate(([0], ends[:-1])), ends)
        order = np.argsort(hashes)
        self.hashes, self.numbers, self.count = hashes[order], order, len(pieces)
        self.longest = max(map(len, pieces), default=1)

    def of_words(self, words):
        """Numbers of the parts of words of one length (rows of bytes): [word, start, length - 1].

        Lengths go up to that of the word or of the longest piece. A part that is no piece has the number ``count``.
        """
        n, size = words.shape
        flat = np.ascontiguousarray(words).reshape(-1)
        sums = texts.prefix_hashes(flat)
        longest = min(size, self.longest)
        found = np.full((n, size, longest), self.count, np.int32)
        rows = np.arange(n)[:, None] * size
        for length in range(1, longest + 1):
            starts = (rows + np.arange(size - length + 1)).reshape(-1)
            hashes = texts.part_hashes(sums, starts, starts + length)
            at = np.minimum(np.searchsorted(self.hashes, hashes), self.count - 1)
            number = np.where(self.hashes[at] == hashes, self.numbers[at], self.count)
            found[:, :size - length + 1, length - 1] = number.reshape(n, -1)
        return found


def _spans(numbers, probability):
    """(start, length) of the parts that are a piece in at least one of the words, by start."""
    return np.argwhere((numbers != len(probability) - 1).any(axis=0)) + (0, 1)


def forward(numbers, probability):
    """Sums over all segmentations of the first i bytes: [word, i, language]."""
    n, size, _ = numbers.shape
    total = np.zeros((n, size + 1, probability.shape[1]))
    total[:, 0] = 1
    for start, length in _spans(numbers, probability):  # all that ends at start is summed before
        total[:, start + length] += total[:, start] * probability[numbers[:, start, length - 1]]
    return total


def backward(numbers, probability):
    """Sums over all segmentations of what follows the first i bytes."""
    n, size, _ = numbers.shape
    total = np.zeros((n, size + 1, probability.shape[1]))
    total[:, size] = 1
    for start, length in _spans(numbers, probability)[::-1]:
        total[:, start] += total[:, start + length] * probability[numbers[:, start, length - 1]]
    return total


def by_length(lengths):
    """Row numbers of words of one length, in blocks of bounded size."""
    order = np.argsort(lengths, kind="stable")
    edges = np.flatnonzero(np.diff(lengths[order])) + 1
    for group in np.split(order, edges):
        for first in range(0, len(group), _BLOCK):
            yield group[first:first + _BLOCK]


def spaced(data, starts, size):
    """Words of one length with a leading space, as rows of bytes."""
    rows = np.full((len(starts), size + 1), 0x20, np.uint8)
    rows[:, 1:] = data[starts[:, None] + np.arange(size)]
    return rows


def letter_words(data, offsets):
    """Starts, ends and text numbers of the words; long ones are cut where a character begins."""
    starts, ends, owners = texts.words(data, offsets, texts.LETTERS)
    sizes = ends - starts
    if len(sizes) and sizes.max() > LONGEST_WORD:
        parts = -(-sizes // LONGEST_WORD)
        at = np.repeat(np.arange(len(sizes)), parts)
        number = np.arange(len(at)) - np.repeat(np.cumsum(parts) - parts, parts)
        cuts = starts[at] + number * LONGEST_WORD
        for _ in range(3):  # a character has at most three bytes after its first
            cuts = cuts - ((number > 0) & ((data[cuts] & 0xC0) == 0x80))
        last = number == parts[at] - 1
        starts, ends, owners = cuts, np.where(last, ends[at], np.append(cuts[1:], 0)), owners[at]
    return starts, ends, owners


def word_counts(labelled, languages):
    """Counts of every word in each language: (word, counts)."""
    def count(batches):
        for batch in batches:
            code = np.array([languages.index(x) for x in batch.column(1).to_pylist()], np.int64)
            for first, data, offsets in texts.slices(batch.column(0)):
                starts, ends, owners = letter_words(data, offsets)
                hashes = texts.word_hashes(data, starts, ends)
                key, some, inverse = np.unique(hashes, return_index=True, return_inverse=True)
                table = np.zeros((len(key), len(languages)))
                np.add.at(table, (inverse, code[first + owners]), 1)
                raw = data.tobytes()
                yield pa.RecordBatch.from_pydict({
                    "word": pa.array([raw[a:b] for a, b in zip(starts[some].tolist(), ends[some].tolist())],
                                     pa.binary()),
                    "counts": pa.array(list(table), pa.list_(pa.float64()))})

    counted = labelled.select("text", "lang").mapInArrow(texts.released(count), "word binary, counts array<double>")
    sums = [F.sum(F.col("counts")[i]) for i in range(len(languages))]
    return counted.groupBy("word").agg(F.array(*sums).alias("counts"))


def expected_uses(counts, pieces, probability):
    """Expected uses of every piece by language over all segmentations: (piece, uses)."""
    def use(batches):
        table = Pieces(pieces)
        padded = scaled(pieces, probability)
        uses = np.zeros_like(padded)
        for batch in batches:
            rows = np.stack(batch.column(1).to_numpy(zero_copy_only=False)) if batch.num_rows else None
            for first, data, offsets in texts.slices(batch.column(0)):
                for chosen in by_length(np.diff(offsets)):
                    size = int(offsets[chosen[0] + 1] - offsets[chosen[0]])
                    numbers = table.of_words(spaced(data, offsets[chosen], size))
                    ahead, behind = forward(numbers, padded), backward(numbers, padded)
                    weight = rows[first + chosen] / ahead[:, -1]
                    for length in range(1, min(size + 1, table.longest) + 1):
                        n = size + 2 - length
                        part = numbers[:, :n, length - 1]
                        share = ahead[:, :n] * padded[part] * behind[:, length:] * weight[:, None]
                        for lang in range(share.shape[2]):
                            uses[:, lang] += np.bincount(part.reshape(-1), share[:, :, lang].reshape(-1), len(uses))
        used = np.flatnonzero(uses[:-1].sum(1))
        yield pa.RecordBatch.from_pydict({
            "piece": pa.array(used.astype(np.int32)),
            "uses": pa.array(list(uses[used]), pa.list_(pa.float64()))})

    partial = counts.select("word", "counts").mapInArrow(texts.released(use), "piece int, uses array<double>")
    sums = [F.sum(F.col("uses")[i]) for i in range(probability.shape[1])]
    return partial.groupBy("piece").agg(F.array(*sums).alias("uses"))


def fit(labelled, sample_texts=SAMPLE_TEXTS, rounds=ROUNDS, vocabulary_name="byte_bpe_50k.tiktoken"):
    """A model from rows of (doc_id, text, lang); null texts and languages are left out.

    Returns (languages, pieces, probability): one row of probabilities per piece, as
    many columns as languages.
    """
    labelled = labelled.where("text IS NOT NULL AND lang IS NOT NULL")
    rows = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(rows)
    pieces = vocabulary(vocabulary_name)
    probability = np.full((len(pieces), max(1, len(languages))), 1.0 / len(pieces))
    if not languages:
        return languages, pieces, probability
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("sample")), F.lit(1 << 20)) / float(1 << 20)
    share = F.element_at(F.create_map(*[x for lang in languages for x in (
        F.lit(lang), F.lit(sample_texts / rows[lang]))]), F.col("lang"))
    counts = stored(word_counts(labelled.where(draw < share), languages), "language-words")
    for _ in range(rounds):
        uses = np.full_like(probability, SMOOTHING)
        for row in expected_uses(counts, pieces, probability).collect():  # a row per piece at most
            uses[row["piece"]] += row["uses"]
        probability = uses / uses.sum(0)
    return languages, pieces, probability


class Scorer:
    """Log-probabilities of words by language; remembers a bounded number of words."""

    def __init__(self, pieces, probability):
        self.table = Pieces(pieces)
        self.padded = scaled(pieces, probability)
        self.keys = np.zeros(0, np.uint64)
        self.values = np.zeros((0, probability.shape[1]), np.float32)

    def words(self, data, starts, ends):
        """Distinct words' log-probabilities, and which of them each word is."""
        hashes = texts.word_hashes(data, starts, ends)
        key, some, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        scores = np.empty((len(key), self.values.shape[1]), np.float32)
        at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        known = self.keys[at] == key if len(self.keys) else np.zeros(len(key), bool)
        scores[known] = self.values[at[known]]
        new = np.flatnonzero(~known)
        sizes = (ends - starts)[some[new]]
        for chosen in by_length(sizes):
            rows = spaced(data, starts[some[new[chosen]]], int(sizes[chosen[0]]))
            sums = forward(self.table.of_words(rows), self.padded)[:, -1]
            scores[new[chosen]] = np.log(sums) - rows.shape[1] * np.log(SCALE)
        if len(self.keys) + len(new) > KNOWN_WORDS:
            self.keys, self.values = key, scores
        else:
            keys = np.concatenate((self.keys, key[new]))
            order = np.argsort(keys)
            self.keys, self.values = keys[order], np.concatenate((self.values, scores[new]))[order]
        return scores, inverse


def predict(documents, model):
    """Adds lang_pred and score to rows of (doc_id, text); the score is the posterior under equal priors.

    Only the text is read by the prediction; every other column passes through as it is.
    """
    languages, pieces, probability = model
    kept = [c for c in documents.columns if c not in ("lang_pred", "score")]
    frame = documents.select(kept)
    schema = T.StructType([*frame.schema.fields, T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType())])

    def label(batches):
        scorer = Scorer(pieces, probability)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text"))
            names, scores = [], []
            for first, data, offsets in texts.slices(column):
                n = len(offsets) - 1
                starts, ends, owners = letter_words(data, offsets)
                total = np.zeros((n, probability.shape[1]))
                if len(starts) and languages:
                    values, at = scorer.words(data, starts, ends)
                    for lang in range(total.shape[1]):
                        total[:, lang] = np.bincount(owners, values[at, lang], n)
                ascii_letter = np.zeros(n, bool)
                letter = ~texts.LETTERS[data] & (data < 0x80)
                ascii_letter[np.searchsorted(offsets, np.flatnonzero(letter), "right") - 1] = True
                best = total.argmax(1)
                posterior = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
                for i in range(n):
                    if not languages or not (ascii_letter[i] or any(
                            c.isalpha() for c in column[first + i].as_py() or "")):
                        names.append(UNKNOWN)
                        scores.append(0.0)
                    else:
                        names.append(languages[best[i]])
                        scores.append(float(posterior[i]))
            arrays = [batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(
                arrays + [pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                [*batch.schema.names, "lang_pred", "score"])

    return frame.mapInArrow(texts.released(label), schema)
