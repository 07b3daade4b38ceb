"""Packing documents into sequences of a fixed number of tokens.

Bounded-space best fit: a fixed number of sequences is open. They are kept by free
space, with a bitset of the spaces that occur, so that the tightest one that holds
a piece is found with one shift. When no open one holds the piece and all places are
taken, the fullest is closed. Texts are encoded where they are read; only lengths are
shuffled, into groups of a bounded number of pieces, and each group is packed on its own.

A null or empty text has the closing id only. Rows that repeat an id are separate
pieces, packed one after the other. An empty table gives an empty result.
"""

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..session import stored
from .tokens import token_ids

SEQUENCE_TOKENS = 1024
CLOSING_ID = 2
OPEN_SEQUENCES = 4096
PIECES_PER_GROUP = 200_000

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PLACED = PIECES + ", sequence_id bigint, offset bigint"


def cuts(n, most):
    """(start, length) of the pieces of ``n`` tokens: all but the first have ``most``."""
    head = n % most
    parts = [(0, head)] if head else []
    return parts + [(start, most) for start in range(head, n, most)]


def encoded_pieces(documents, most=SEQUENCE_TOKENS, closing=CLOSING_ID):
    """One row per piece of (doc_id, text): its place in the document and the checksum of its ids."""
    def encode(batches):
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = np.append(token_ids(text), np.uint32(closing)).astype("<u4")
                for number, (start, length) in enumerate(cuts(len(ids), most)):
                    rows.append((doc_id, number, start, length, zlib.crc32(ids[start:start + length].tobytes())))
            if rows:
                frame = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
                yield frame.astype({"doc_id": "Int64", "piece": "int32"})

    return documents.select("doc_id", "text").mapInPandas(encode, PIECES)


class OpenSequences:
    """A fixed number of open sequences by free space."""

    def __init__(self, size, places):
        self.size, self.places = size, places
        self.spaces, self.by_space = 0, [[] for _ in range(size + 1)]
        self.count = self.made = 0

    def put(self, length):
        """Number of the sequence that takes a piece, and the piece's offset there."""
        fitting = self.spaces >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            number = self._take(space)
        else:
            if self.count == self.places and length < self.size:
                self._take((self.spaces & -self.spaces).bit_length() - 1)
            space, number = self.size, self.made
            self.made += 1
        if space > length:
            self._open(space - length, number)
        return number, self.size - space

    def _open(self, space, number):
        self.by_space[space].append(number)
        self.spaces |= 1 << space
        self.count += 1

    def _take(self, space):
        number = self.by_space[space].pop()
        if not self.by_space[space]:
            self.spaces ^= 1 << space
        self.count -= 1
        return number


def packed(pieces, size=SEQUENCE_TOKENS, places=OPEN_SEQUENCES, pieces_per_group=PIECES_PER_GROUP):
    """Place pieces of at most ``size`` tokens: adds sequence_id and offset.

    The group of a piece depends on its id and number only, and within a group long
    pieces come first, so a lost task gives the same places again.
    """
    groups = max(1, -(-pieces.count() // pieces_per_group))
    group = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)).cast("int")

    def place(batches):
        current, bins = None, None
        for batch in batches:
            numbers, offsets = [], []
            for own, length in zip(batch["group"].tolist(), batch["length"].tolist()):
                if own != current:
                    current, bins = own, OpenSequences(size, places)
                number, offset = bins.put(length)
                numbers.append(own << 40 | number)
                offsets.append(offset)
            yield batch.drop(columns="group").assign(sequence_id=numbers, offset=offsets)

    return (
        pieces.withColumn("group", group)
        .repartition(groups, "group")
        .sortWithinPartitions("group", F.desc("length"), "doc_id", "piece", "start", "ids_crc32")
        .mapInPandas(place, PLACED)
    )


def pack_documents(documents, **options):
    """Encode documents and pack all of their pieces; see ``PLACED``."""
    return packed(stored(encoded_pieces(documents), "pieces"), **options)
