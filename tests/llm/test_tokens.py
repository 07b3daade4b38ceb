"""Token ids, section counts and packing."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from reviewloom.llm import attribution, packing, queries, tokens

SF_DIR = "/root/testdata/sf0.01"
DOCUMENTS = "doc_id bigint, text string"


def defining(text):
    return tokens.defining_tokenizer().encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_ids_are_those_of_the_defining_library(text):
    assert tokens.token_ids(text).tolist() == defining(text)


@pytest.mark.parametrize("text", ["", "a" * 20_000, " " * 20_000, "x<|endoftext|>y", "é　’s 😀 1234\r\n\t x"])
def test_ids_of_odd_texts(text):
    assert tokens.token_ids(text).tolist() == defining(text)


@settings(max_examples=100, deadline=None)
@given(st.text(min_size=1))
def test_spans_are_the_characters_of_the_tokens(text):
    begin, end = attribution.token_spans(text)
    pieces = [*tokens.piece_bytes(), tokens.SPECIAL.encode()]
    place = 0
    for i, b, e in zip(tokens.token_ids(text), begin, end):
        size = len(pieces[i])
        assert text[b:e].encode().find(pieces[i]) >= 0
        place += size
    assert place == len(text.encode())


def test_crossing_tokens_follow_the_rule():
    section = (np.array([0, 4]), np.array([4, 9]))
    token = (np.array([0, 3, 8]), np.array([3, 8, 9]))
    for rule, want in (("first", [0, 0, 1]), ("last", [0, 1, 1]), ("longest", [0, 1, 1])):
        at, crossing = attribution.allocate(*token, *section, rule)
        assert at.tolist() == want
        assert crossing.tolist() == [False, True, False]


def test_given_sections_and_edge_cases(spark):
    schema = DOCUMENTS + ", parts array<struct<name: string, `from`: bigint, `to`: bigint>>, name string"
    rows = [(1, "hello world again", [("a", 0, 5), ("b", 11, 17)], "clash"), (2, None, [("a", 0, 5)], None),
            (3, "x", None, None), (None, "y", [], None)]
    found = attribution.attributed_tokens(spark.createDataFrame(rows, schema), "parts").collect()
    got = sorted(((r["doc_id"], r["section"], r["name"], r["n_tokens"]) for r in found), key=str)
    assert got == sorted([(1, 0, "a", 1), (1, 1, "b", 1), (1, None, None, 1), (2, 0, "a", 0),
                          (3, None, None, 1), (None, None, None, 1)], key=str)
    assert attribution.attributed_tokens(spark.createDataFrame([], DOCUMENTS)).count() == 0


def test_line_counts_of_the_whole_table(spark):
    """Every token is counted once, in the line of its first character."""
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    totals, lines = {}, {}
    for r in queries.QUERIES["op3_token_counts"](spark, SF_DIR).collect():
        totals[r["doc_id"]] = totals.get(r["doc_id"], 0) + r["n_tokens"]
        lines[r["doc_id"], r["section"]] = (r["start"], r["n_chars"], r["n_tokens"])
    assert totals == {i: len(defining(t)) for i, t in texts.items() if t}
    for i in list(texts)[:60]:
        offsets = tokens.defining_tokenizer().encode(texts[i], add_special_tokens=False).offsets
        counts = {}
        for begin, _ in offsets:
            line = texts[i].count("\n", 0, begin)
            counts[line] = counts.get(line, 0) + 1
        begin = 0
        for number, line in enumerate(texts[i].splitlines(keepends=True) if "\r" not in texts[i] else []):
            if not set(line[:-1]) & set("\v\f\x1c\x1d\x1e\x85  "):
                assert lines[i, number] == (begin, len(line), counts.get(number, 0))
            begin += len(line)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=200), st.integers(1, 8))
def test_best_fit_against_brute_force(lengths, places):
    """The tightest open sequence takes a piece; the fullest closes first."""
    bins, open_, made, placed = packing.OpenSequences(16, places), {}, 0, []
    for length in lengths:
        fitting = [n for n, used in open_.items() if 16 - used >= length]
        number, offset = bins.put(length)
        if fitting:
            tightest = max(open_[n] for n in fitting)
            assert number in open_ and open_[number] == tightest == offset
        else:
            if len(open_) == places and length < 16:
                fullest = max(open_.values())
                open_ = {n: used for n, used in open_.items() if used < fullest or n != bins_closed(bins, open_, n)}
            assert (number, offset) == (made, 0)
            made += 1
        open_[number] = offset + length
        open_ = {n: used for n, used in open_.items() if n in still_open(bins)}
        placed.append((number, offset, length))
        assert len(open_) <= places
    for number in {n for n, _, _ in placed}:
        edges = [(o, o + n) for m, o, n in placed if m == number]
        assert edges[0][0] == 0 and edges[-1][1] <= 16
        assert all(a[1] == b[0] for a, b in zip(edges, edges[1:]))


def still_open(bins):
    return {n for numbers in bins.by_space for n in numbers}


def bins_closed(bins, open_, n):
    return None if n in still_open(bins) else n


def test_cuts():
    assert packing.cuts(1024, 1024) == [(0, 1024)]
    assert packing.cuts(3, 1024) == [(0, 3)]
    assert packing.cuts(2050, 1024) == [(0, 2), (2, 1024), (1026, 1024)]


def check_packing(spark, documents, **options):
    rows = documents.collect()
    found = packing.pack_documents(documents, **options).collect()
    pieces, sequences = {}, {}
    for r in found:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for row in rows:
        ids = np.array([*defining(row["text"] or ""), 2], "<u4")
        own = sorted(pieces[row["doc_id"]], key=lambda r: r["piece"])
        assert [r["start"] for r in own] == [s for s, _ in packing.cuts(len(ids), 1024)]
        for r in own:
            part = ids[r["start"]:r["start"] + r["length"]]
            assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"]
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 1024
    return len(sequences), sum(r["length"] for r in found)


def test_packing_of_the_whole_table(spark):
    made, total = check_packing(spark, spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text"))
    assert made <= 1.01 * total / 1024 + 1


def test_packing_edge_cases(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "word " * 30_000, "x"), (4, "a", "x"), (None, "null id", "x")]
    check_packing(spark, spark.createDataFrame(rows, DOCUMENTS + ", piece string"), pieces_per_group=2)
    twice = spark.createDataFrame([(1, "same text"), (1, "same text")], DOCUMENTS)
    assert packing.pack_documents(twice).select("sequence_id", "offset").distinct().count() == 2
    assert packing.pack_documents(spark.createDataFrame([], DOCUMENTS)).count() == 0
