"""Token counts of the sections of a document, from one encoding of the whole document.

A document is encoded once, as a model would read it. The character spans of its
tokens are joined as intervals to the spans of its sections, and every token is
counted in exactly one section:

* ``first``: the section that holds its first character (default),
* ``last``: the section that holds its last character,
* ``longest``: the section that holds most of its characters, the earlier one of equals.

Sections are the lines of the text, each with its line break, or the spans of an
array column of structs (name, from, to) in characters, in order and apart. Tokens
that by the rule belong to no section are counted in a row whose section is null,
given only if there are any. A null or empty text has no lines and gives no row for
them; given sections of it have 0 tokens. Characters that one token shares with its
neighbours (parts of a character) belong to each of them.
"""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from .tokens import piece_lengths, token_ids

RULES = ("first", "last", "longest")
COUNTS = ("doc_id bigint, section int, name string, start bigint, n_chars bigint, "
          "n_tokens bigint, n_crossing bigint")


def token_spans(text):
    """First character and character after the last one of every token of a text."""
    ids = token_ids(text)
    ends = np.cumsum(piece_lengths()[ids])
    starts = ends - piece_lengths()[ids]
    data = np.frombuffer(text.encode(), np.uint8)
    character = np.cumsum((data & 0xC0) != 0x80) - 1
    return character[starts], character[ends - 1] + 1


def line_spans(text):
    """Spans of the lines of a text, line breaks included."""
    ends = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 10) + 1
    if not len(ends) or ends[-1] < len(text):
        ends = np.append(ends, len(text))
    return np.concatenate(([0], ends[:-1])), ends


def allocate(token_from, token_to, section_from, section_to, rule="first"):
    """Number of the section of every token, or -1, and whether it crosses an edge of a section."""
    def holding(character):
        at = np.searchsorted(section_from, character, "right") - 1
        inside = (at >= 0) & (character < section_to[np.maximum(at, 0)])
        return np.where(inside, at, -1)

    if not len(section_from):
        none = np.full(len(token_from), -1)
        return none, np.zeros(len(token_from), bool)
    first, last = holding(token_from), holding(token_to - 1)
    crossing = first != last
    if rule == "first":
        return first, crossing
    if rule == "last":
        return last, crossing
    best = first.copy()
    for i in np.flatnonzero(crossing | (first < 0)):  # few: tokens over an edge, or outside
        low = np.searchsorted(section_to, token_from[i], "right")
        high = np.searchsorted(section_from, token_to[i], "left")
        if low < high:
            shared = (np.minimum(section_to[low:high], token_to[i])
                      - np.maximum(section_from[low:high], token_from[i]))
            best[i] = low + int(np.argmax(shared))
        else:
            best[i] = -1
    return best, crossing


def attributed_tokens(documents, sections=None, rule="first"):
    """Tokens of each section of (doc_id, text): see ``COUNTS``.

    ``sections`` names an array column of structs (name, from, to); without it the
    lines are the sections. ``n_crossing`` counts the section's tokens that lie over
    one of its edges.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def count(batches):
        for batch in batches:
            columns = [[] for _ in range(7)]
            for row in batch.itertuples(index=False):
                text = row[1] or ""
                if sections is None:
                    begin, end = line_spans(text) if text else (np.zeros(0, np.int64),) * 2
                    names = [None] * len(begin)
                else:
                    spans = [] if row[2] is None else [s for s in row[2] if s is not None]
                    begin = np.array([s["from"] for s in spans], np.int64)
                    end = np.array([s["to"] for s in spans], np.int64)
                    names = [s["name"] for s in spans]
                at, crossing = np.zeros(0, np.int64), np.zeros(0, bool)
                if text:
                    at, crossing = allocate(*token_spans(text), begin, end, rule)
                tokens = np.bincount(at + 1, minlength=len(begin) + 1)
                over = np.bincount(at + 1, crossing, minlength=len(begin) + 1)
                numbers, first = list(range(len(begin))), 1
                begin, length = begin.tolist(), (end - begin).tolist()
                if tokens[0]:
                    numbers, names, begin, length, first = (
                        [None, *numbers], [None, *names], [None, *begin], [None, *length], 0)
                for column, values in zip(columns, (
                        [row[0]] * len(numbers), numbers, names, begin, length,
                        tokens[first:].tolist(), over[first:].astype(np.int64).tolist())):
                    column += values
            frame = pd.DataFrame(dict(zip(
                ("doc_id", "section", "name", "start", "n_chars", "n_tokens", "n_crossing"), columns)))
            yield frame.astype({"doc_id": "Int64", "section": "Int32", "start": "Int64", "n_chars": "Int64"})

    chosen = ["doc_id", "text"] + ([sections] if sections else [])
    return documents.select(*map(F.col, chosen)).mapInPandas(count, COUNTS)
