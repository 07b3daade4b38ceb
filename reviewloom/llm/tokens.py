"""Token ids of whole texts with a public byte-level vocabulary.

The vocabulary files stay where they are installed; only their names are parameters.
"""

import base64
import functools
import re

import numpy as np
import public_tokenizers
import tiktoken
import tokenizers

VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"

#: The special token is one id for the library that the ids are defined by.
SPECIAL = "<|endoftext|>"
#: Runs that a plain merge loop or a backtracking pattern would take long over.
LONG_RUN = re.compile(r"\S{4000}|\s{4000}")


@functools.cache
def defining_tokenizer(name=VOCABULARY):
    return tokenizers.Tokenizer.from_file(public_tokenizers.path(name))


@functools.cache
def rank_tokenizer(name=RANKS):
    with open(public_tokenizers.path(name), "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.cache
def piece_bytes(name=RANKS):
    """The bytes of every id, in order of the ids."""
    with open(public_tokenizers.path(name), "rb") as lines:
        ranks = {int(rank): base64.b64decode(piece) for piece, rank in map(bytes.split, lines)}
    return [ranks[i] for i in range(len(ranks))]


@functools.cache
def piece_lengths(name=RANKS):
    """Bytes that each id stands for; the id after the last one is the special token."""
    return np.array([*map(len, piece_bytes(name)), len(SPECIAL)], np.int64)


def token_ids(text):
    """The ids of a whole text, as ``uint32``.

    The same as ``defining_tokenizer().encode(text, add_special_tokens=False).ids``.
    The rank form of the vocabulary gives them in a quarter of the time; texts in
    which the two could differ, or which it is slow on, take the defining form.
    """
    if not text:
        return np.zeros(0, np.uint32)
    if SPECIAL in text or LONG_RUN.search(text):
        return np.array(defining_tokenizer().encode(text, add_special_tokens=False).ids, np.uint32)
    return rank_tokenizer().encode_to_numpy(text, disallowed_special=())
