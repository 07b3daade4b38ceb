"""Source mix: targets by repeated sharing, budgets, edge cases, copies and cuts."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from reviewloom.llm import mixing

SIZES = "doc_id bigint, source string, size bigint"


def shared_out(sizes, weights=(1, 2, 3), most=3):
    """Share by weight; what is above a limit goes to the others, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        left = sum(weight[s] for s in order if s not in full)
        target = {s: most * sizes[s] if s in full else rest * weight[s] / left for s in order}
        above = {s for s in order if s not in full and target[s] > most * sizes[s]}
        if not above:
            return target
        full |= above


@pytest.mark.parametrize("seed", range(4))
def test_targets_and_budgets(spark, seed):
    r = random.Random(seed)
    names = [None, "", "a", "b", "Z", "é", "\U0001f600", "￿", "c", "d"]
    rows = [(i, s, r.choice((0, 1, 5, 50))) for i, s in enumerate(
        r.choices(names, [r.choice((1, 3, 40)) for _ in names], k=400))]
    sizes = {s: sum(n for _, x, n in rows if x == s) for s in {x for _, x, _ in rows}}
    want = shared_out(sizes)
    got = mixing.take_words(spark.createDataFrame(rows, SIZES), rows_per_range=20).collect()
    assert sorted(x["doc_id"] for x in got) == list(range(400))
    taken = {}
    for x in got:
        assert x["target"] == pytest.approx(want[x["source"]], abs=1e-6)
        assert 0 <= x["taken"] <= 3 * x["size"] and x["source_size"] == sizes[x["source"]]
        taken[x["source"]] = taken.get(x["source"], 0) + x["taken"]
    assert all(abs(taken[s] - want[s]) < 1.001 for s in sizes)


def test_ranges_do_not_change_the_mix(spark):
    rows = [(i, "ab"[i % 7 == 0], i % 11) for i in range(300)]
    frame = spark.createDataFrame(rows, SIZES)
    a, b, c = (sorted(map(tuple, mixing.take_words(frame, rows_per_range=n, ranges_per_span=m).collect()))
               for n, m in ((10, 2000), (10, 3), (10 ** 6, 2000)))
    assert a == b == c


def test_word_count(spark):
    texts = [None, "", " \t\n", "one", " two words ", "a b c", "x" * 100_000, "y " * 100_000]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(
        mixing.word_count(F.col("t"))).collect()]
    assert got == [0, 0, 0, 1, 2, 2, 1, 100_000]


def test_edge_cases(spark):
    empty = spark.createDataFrame([], SIZES)
    assert mixing.take_words(empty).count() == 0
    nothing = spark.createDataFrame([(1, "a", 0), (2, None, 0)], SIZES)
    assert [r["taken"] for r in mixing.take_words(nothing).collect()] == [0, 0]
    twice = spark.createDataFrame([(1, "a", 4, "z", "t"), (1, "a", 4, "z", "t"), (None, "a", 2, "z", "t")],
                                  SIZES + ", key string, target string")
    assert sum(r["taken"] for r in mixing.take_words(twice).collect()) == 10


def test_mixed_documents(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, words string"
    rows = [(i, " ".join(f"w{i}_{j}" for j in range(i % 13)), "en", "abc"[i % 3], 5, "clash") for i in range(120)]
    rows += [(500, None, None, None, None, None), (None, "x y", "en", "a", 3, "n")]
    documents = spark.createDataFrame(rows, schema)
    mixed = mixing.mixed_documents(documents)
    assert mixed.schema.names == documents.schema.names
    # a row without an id goes by its source and text
    names = {r[0]: str(r[0]) for r in rows} | {None: "no id " + hashlib.md5(b"1:ax y").hexdigest()}
    sizes = [(names[r[0]], r[3], len((r[1] or "").split())) for r in rows]
    sizes = spark.createDataFrame(sizes, "doc_id string, source string, size bigint")
    taken = {r["doc_id"]: r["taken"] for r in mixing.take_words(sizes).collect()}
    got, whole = {}, {r[0]: r for r in rows}
    for r in mixed.collect():
        name = names[r["doc_id"]]
        got[name] = got.get(name, 0) + len(r["text"].split())
        assert whole[r["doc_id"]][1].startswith(r["text"])
        assert r["n_chars"] == (whole[r["doc_id"]][4] if r["text"] == whole[r["doc_id"]][1] else len(r["text"]))
    assert got == {name: n for name, n in taken.items() if n} and names[None] in got


def test_rows_without_an_id_are_mixed(spark):
    """They keep their texts and their source's budget, and rows of one source are told apart by text."""
    rows = [(None, "a b", "x"), (None, "c d e", "x"), (1, "f", "x"), (2, "g h", "y"), (None, None, "x")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = [tuple(r) for r in mixing.mixed_documents(frame, weights=(3, 1)).collect()]
    assert {r for r in got if r[2] == "x"} == {r for r in rows[:3]}
    assert sum(len(r[1].split()) for r in got if r[2] == "x") == 6
    assert {r[2] for r in got} == {"x", "y"}


def test_equal_limits_by_weight(spark):
    """Of sources that reach their limits at the same share the first one sets the level."""
    rows = [(1, "a", 2), (2, "b", 4), (3, "c", 6), (4, None, 2)]
    got = {r["source"]: (r["target"], r["taken"]) for r in mixing.take_words(spark.createDataFrame(rows, SIZES)).collect()}
    want = shared_out({s: n for _, s, n in rows})
    assert got == {s: (want[s], int(want[s])) for _, s, _ in rows}


@pytest.mark.parametrize("lot", [1_000, 3])
def test_rows_that_repeat_an_id_stay_within_the_budget(spark, lot):
    """Other rows of an id have places of their own, equal rows share one; no source takes more than its target."""
    rows = [(7, f"t{i} u{i} v{i}", "a", "de") for i in range(9)] + [(7, "t0 u0 v0", "a", "fr")]   # one id, ten rows
    rows += [(8, "p q r s", "b", "de")] * 40 + [(8, "p q r s", "c", "de")] * 3                   # equal rows
    rows += [(None, "n m", "c", None)] * 11 + [(i, f"w{i}", "c", "en") for i in range(20, 40)]
    rows += [(9, None, "c", None), (9, "", "c", None)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")
    sizes = {s: sum(len((t or "").split()) for _, t, x, _ in rows if x == s) for s in "abc"}
    want = shared_out(sizes)
    got = [tuple(r) for r in mixing.mixed_documents(frame, copies_per_lot=lot).collect()]
    words = {s: sum(len(t.split()) for _, t, x, _ in got if x == s) for s in "abc"}
    assert words == {s: int(want[s]) for s in "abc"}
    for s in "abc":
        counts = {row: (sum(row == g for g in got), sum(row == r for r in rows)) for row in rows if row[2] == s and row[1]}
        whole = int(want[s] // sizes[s])
        assert all(whole * n <= found <= (whole + 1) * n for found, n in counts.values())
        cut = [g for g in got if g[2] == s and g not in counts]
        assert len(cut) <= 1 and all(any(r[1].startswith(g[1]) for r in counts) for g in cut)
