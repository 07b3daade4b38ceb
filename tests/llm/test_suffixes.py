"""Repeated byte strings against brute force over all strings."""

import collections
import hashlib
import random

import pytest

from reviewloom.llm import queries, suffixes

SF_DIR = "/root/testdata/sf0.01"
SCHEMA = "doc_id bigint, text string"


def brute_force(rows, length):
    counts = collections.Counter()
    encoded = [(i, (text or "").encode()) for i, text in rows]
    for _, data in encoded:
        for j in range(len(data) - length + 1):
            counts[data[j:j + length] if length < 100 else hash(data[j:j + length])] += 1
    out = []
    for i, data in encoded:
        covered = bytearray(len(data))
        for j in range(len(data) - length + 1):
            if counts[data[j:j + length] if length < 100 else hash(data[j:j + length])] > 1:
                covered[j:j + length] = b"\1" * length
        spans = sum(1 for k, c in enumerate(covered) if c and (k == 0 or not covered[k - 1]))
        kept = bytes(c for k, c in enumerate(data) if not covered[k])
        out.append((i, len(data), sum(covered), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(frame, **options):
    rows = suffixes.without_repeats(frame, **options).drop("spans", "kept_text").collect()
    return sorted((tuple(r) for r in rows), key=str)


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    result = queries.QUERIES["op6_repeated_bytes"](spark, SF_DIR).collect()
    got = sorted((tuple(r)[:5] for r in result), key=str)
    assert got == brute_force(rows, 400)
    whole = dict(rows)
    for r in result:
        left = r["kept_text"].encode()
        assert hashlib.sha256(left).hexdigest() == r["kept_sha256"] or len(left) < r["n_bytes"] - r["n_removed"]
        assert r["n_removed"] or r["kept_text"] == (whole[r["doc_id"]] or "")


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("large_name", [1, 2000])
def test_small_alphabets(spark, seed, large_name, monkeypatch):
    """Many overlapping repeats, in and across texts; both ways of settling a name."""
    monkeypatch.setattr(suffixes, "LARGE_NAME", large_name)
    r = random.Random(seed)
    parts = ["".join(r.choice("ab") for _ in range(r.randint(10, 90))) for _ in range(5)]
    rows = [(i, "".join(r.choice(parts) if r.random() < 0.6 else
                        "".join(r.choice("abcdé") for _ in range(r.randint(1, 60)))
                        for _ in range(r.randint(0, 6)))) for i in range(30)]
    assert found(spark.createDataFrame(rows, SCHEMA), length=64, k=16) == brute_force(rows, 64)


def test_edge_cases(spark):
    long = "".join(random.Random(1).choice("abcdefgh ") for _ in range(3000))
    rows = [(1, None), (2, ""), (3, "a" * 1000), (4, "a" * 399), (5, "ab" * 300), (6, long), (7, long + "tail"),
            (8, long[200:]), (9, "é" * 500), (None, long[1000:2000])]
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute_force(rows, 400)
    assert found(spark.createDataFrame([], SCHEMA)) == []
    twice = [(1, long), (1, long), (2, "short")]
    assert found(spark.createDataFrame(twice, SCHEMA)) == brute_force(twice, 400)
    clash = spark.createDataFrame([(1, "x", "y")], SCHEMA + ", text_key string")
    assert found(clash) == brute_force([(1, "x")], 400)


def test_a_text_longer_than_a_slice(spark, monkeypatch):
    monkeypatch.setattr(suffixes.texts, "SLICE_BYTES", 1000)
    r = random.Random(2)
    part = "".join(r.choice("abcdefgh ") for _ in range(900))
    rows = [(1, "".join(r.choice("abc") for _ in range(2500)) + part), (2, part[5:] + "end")]
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute_force(rows, 400)


def test_many_equal_rows(spark):
    """Work grows with the rows, also where id and text repeat, with and without an id."""
    r = random.Random(5)
    long, other = ("".join(r.choice("abcdefgh ") for _ in range(3000)) for _ in range(2))
    rows = [(7, long)] * 1500 + [(None, other)] * 1500 + [(1, "x" + other[500:1500] + "y"), (2, "short")]
    want = {(7, long): (3000, 3000, 1), (None, other): (3000, 3000, 1), (1, rows[-2][1]): (1002, 1000, 1),
            (2, "short"): (5, 0, 0)}
    got = suffixes.without_repeats(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(g["doc_id"]), g["n_bytes"], g["n_removed"], g["n_spans"]) for g in got) == sorted(
        (str(row[0]), *want[row]) for row in rows)
