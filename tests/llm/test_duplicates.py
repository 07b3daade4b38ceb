"""Near-duplicates of vectors and documents, repeated passages, components: against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewloom.llm import components, neighbours, passages, sketches

VECTORS = "id bigint, label int, vector array<double>"
DOCUMENTS = "doc_id bigint, text string"


def joined(ids, links):
    root = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            least = min(root[a], root[b])
            if root[a] != least or root[b] != least:
                root[a] = root[b] = least
                changed = True
    return root


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    r = random.Random(seed)
    links = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)]
    frame = spark.createDataFrame([*links, (5, 5), (None, 3)], "a bigint, b bigint")
    got = {x["id"]: x["component_id"] for x in components.components(frame).collect()}
    want = joined({i for link in links for i in link}, links)
    assert got == {i: c for i, c in want.items() if any(i in link and link[0] != link[1] for link in links)}
    assert components.components(frame.where("a < 0")).count() == 0


def close_vectors(rng, n, dim=16, groups=12):
    centres = rng.standard_normal((groups, dim))
    return centres[rng.integers(0, groups, n)] + rng.standard_normal((n, dim)) * rng.choice([0, 0.06, 0.1, 0.5], (n, 1))


@pytest.mark.parametrize("cell_rows, chunk_rows", [(1500, 1024), (40, 30)])
def test_near_vectors(spark, cell_rows, chunk_rows):
    rng = np.random.default_rng(3)
    vectors = close_vectors(rng, 400)
    labels = rng.integers(0, 2, 400)
    rows = [(i, int(labels[i]), vectors[i].tolist()) for i in range(400)]
    frame = spark.createDataFrame(rows, VECTORS)
    got = {r["id"]: tuple(r)[1:] for r in neighbours.near_vectors(
        frame, cell_rows=cell_rows, chunk_rows=chunk_rows).collect()}
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.98) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(near, False)
    links = list(zip(*np.nonzero(near)))
    root = joined(range(400), links)
    want = {i: (int(near[i].sum()), root[i], root[i] == i) for i in range(400)}
    assert sum(got[i] == want[i] for i in want) >= 398
    assert all(got[i][0] <= want[i][0] for i in want)
    assert len(links) > 1000


def test_near_vectors_edge_cases(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, 0, [1.0, 0.0]), (2, 0, [2.0, 0.0]), (3, None, [1.0, 0.0]), (4, 0, None), (5, 0, [0.0, 0.0]),
            (6, 0, [nan, 1.0]), (7, 0, [inf, 1.0]), (8, 0, [None, 1.0]), (9, 0, []), (10, 1, [1.0, 0.0]),
            (11, 0, [1.0, 0.0, 0.0]), (12, 0, [1.0, 0.001]), (12, 0, [1.0, 0.001]), (None, 0, [1.0, 0.0])]
    extra = spark.createDataFrame(rows, VECTORS).withColumn("component_id", F.lit("clash"))
    got = sorted((tuple(r) for r in neighbours.near_vectors(extra).collect()), key=str)
    alone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11)]
    assert got == sorted([(1, 3, 1, True), (2, 3, 1, False), (12, 3, 1, False), (12, 3, 1, False),
                          (None, 0, None, True), *alone], key=str)
    assert neighbours.near_vectors(spark.createDataFrame([], VECTORS)).count() == 0


def test_needed_collisions_keep_the_recall():
    needed = neighbours.needed_collisions()
    rng = np.random.default_rng(0)
    hits = (np.abs(rng.standard_normal((20_000, neighbours.PROJECTIONS))) < neighbours.WINDOW).sum(1)
    assert 15 < needed < 30 and (hits >= needed).mean() > 0.999


def changed(r, words, share):
    return [r.choice(("new", "other", "word")) + str(r.randint(0, 99)) if r.random() < share else w for w in words]


@pytest.mark.parametrize("chunk_sets", [400, 7])
def test_near_documents(spark, chunk_sets):
    """A large group with a common beginning, whose members are partly alike only, and copies."""
    r = random.Random(4)
    base = [f"w{r.randint(0, 5000)}" for _ in range(150)]
    line = [f"l{i}" for i in range(40)]
    rows = [(i, " ".join(changed(r, base, r.choice((0, 0.01, 0.03, 0.08))))) for i in range(120)]
    rows += [(200 + i, " ".join(line + [f"x{r.randint(0, 9999)}" for _ in range(r.randint(0, 60))])) for i in range(80)]
    rows += [(300 + i, rows[i][1].upper()) for i in range(0, 200, 7)]
    frame = spark.createDataFrame(rows, DOCUMENTS)
    got = {x["doc_id"]: tuple(x)[1:] for x in sketches.near_documents(
        frame, 3, (85, 100), chunk_sets=chunk_sets).collect()}

    def shingles(text):
        words = text.lower().split()
        return {tuple(words[i:i + 3]) for i in range(max(1, len(words) - 2))}

    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b
             and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    root = joined(sets, links)
    assert got == {i: (len(s), root[i], root[i] == i) for i, s in sets.items()}
    assert len(set(root.values())) > 50 and len(links) > 500


def test_near_documents_of_few_words(spark):
    """The smallest sets that differ and still are alike: one word more at either end, or in a set of six."""
    rows, want = [], {}
    for n in (8, 9, 10, 12):
        for i in range(0, 200, 2):
            text = [f"s{n}x{i}y{j}" for j in range(n)]
            a = 1000 * n + i
            rows += [(a, " ".join(text)), (a + 1, " ".join(text + ["more"]))]
            want |= {a: a, a + 1: a}
    got = sketches.near_documents(spark.createDataFrame(rows, DOCUMENTS)).collect()
    assert {x["doc_id"]: x["component_id"] for x in got} == want


def test_the_estimate_parts_no_pair(spark):
    sets = {1: [1, 2, 3, *range(90, 96)], 5: [1, 2, 3, 11, 12, 13], 6: [1, 2, 3, 11, 12, 13, 14]}
    rows = [(i, bytearray(np.array(values, np.uint64).tobytes()), [77]) for i, values in sets.items()]
    frame = spark.createDataFrame(rows, "rep bigint, sketch binary, entries array<bigint>")
    links = [(x["a"], x["b"]) for x in sketches.candidate_links(frame, similarity=(85, 100)).collect()]
    assert joined([1, 5, 6], links)[5] == joined([1, 5, 6], links)[6]


def test_near_documents_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "One  two"), (8, "É x y z"),
            (9, "é x y z"), (None, "one"), (4, "one"), (10, "word " * 100_000), (11, "word " * 99_999), (12, "two one")]
    frame = spark.createDataFrame(rows, DOCUMENTS).withColumn("n_shingles", F.lit("clash"))
    got = sorted((tuple(r) for r in sketches.near_documents(frame, 3, (85, 100)).collect()), key=str)
    assert got == sorted([
        (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (4, 1, 4, True), (5, 1, 4, False),
        (6, 1, 6, True), (7, 1, 6, False), (8, 2, 8, True), (9, 2, 9, True), (10, 1, 10, True), (11, 1, 10, False),
        (12, 1, 12, True), (None, 1, None, True)], key=str)
    assert sketches.near_documents(spark.createDataFrame([], DOCUMENTS)).count() == 0


def planted(r):
    """Texts of unrelated words with passages, some of them changed a little, in several texts."""
    def words(n):
        return [f"v{r.randint(0, 10 ** 6)}" for _ in range(n)]

    shared = [words(60), words(80), words(400)]
    texts, marks = {}, {}
    for i in range(120):
        body = words(r.randint(60, 200))
        if i % 3 == 0:
            passage = changed(r, shared[i % 9 // 3], r.choice((0, 0, 0.04)))
            at = r.randint(0, len(body))
            body[at:at] = passage
            marks[i] = (at, at + len(passage))
        texts[i] = body
    return texts, marks


def test_planted_passages_are_found_and_others_are_not(spark):
    texts, marks = planted(random.Random(5))
    rows = [(i, " ".join(t)) for i, t in texts.items()]
    found = passages.repeated_passages(spark.createDataFrame(rows, DOCUMENTS)).collect()
    firsts = {0, 3, 6}
    assert {r["doc_id"] for r in found} == set(marks) - firsts
    covered = {}
    for r in found:
        assert r["from_doc_id"] < r["doc_id"] and r["n_words"] >= 50
        covered.setdefault(r["doc_id"], set()).update(range(r["start"], r["start"] + r["n_words"]))
    for i, (b, e) in marks.items():
        if i not in firsts:
            assert len(covered[i] & set(range(b, e))) >= 0.9 * (e - b)
            assert len(covered[i] - set(range(b, e))) <= 6


def test_passage_of_which_every_short_part_occurs_before(spark):
    r = random.Random(8)
    words = lambda n: [f"v{r.randint(0, 10 ** 6)}" for _ in range(n)]
    passage = words(90)
    rows = [(i, " ".join(words(60) + passage[6 * i:6 * i + 12] + words(60))) for i in range(15)]
    rows += [(i, " ".join(words(70) + passage + words(70))) for i in (20, 21, 22)]
    found = passages.repeated_passages(spark.createDataFrame(rows, DOCUMENTS)).collect()
    assert {(x["doc_id"], x["from_doc_id"]) for x in found} == {(21, 20), (22, 20)}
    assert all(x["n_words"] >= 86 for x in found)


def spread_changes(r, words, n):
    """``n`` of the words replaced, but for the first and the last."""
    out = list(words)
    for i in r.sample(range(1, len(words) - 1), n):
        out[i] = f"x{r.randint(0, 10 ** 9)}"
    return out


def test_changed_passages_are_found(spark):
    r = random.Random(33)
    words = lambda n: [f"v{r.randint(0, 10 ** 6)}" for _ in range(n)]
    rows, marks = [], {}
    for i in range(0, 600, 2):
        passage = words((50, 60, 80)[i % 3])
        if i < 60:  # every sixth word
            other = [f"x{i}.{j}" if j % 6 == 5 and j + 1 < len(passage) else w for j, w in enumerate(passage)]
        else:
            other = spread_changes(r, passage, len(passage) * (10, 15, 20)[i // 6 % 3] // 100)
        rows += [(i, " ".join(words(60) + passage + words(60))), (i + 1, " ".join(words(70) + other + words(50)))]
        marks[i + 1] = set(range(70, 70 + len(passage)))
    found = passages.repeated_passages(spark.createDataFrame(rows, DOCUMENTS)).collect()
    covered = {}
    for x in found:
        assert x["from_doc_id"] + 1 == x["doc_id"] and x["n_words"] >= 50
        assert x["n_equal"] >= 0.8 * max(x["n_words"], x["from_n_words"])
        covered.setdefault(x["doc_id"], set()).update(range(x["start"], x["start"] + x["n_words"]))
    whole = {i for i, mark in marks.items() if len(mark & covered.get(i, set())) >= 0.9 * len(mark)}
    assert all(i in whole for i in marks if i < 60)
    assert len(whole) >= 0.98 * len(marks)


@pytest.mark.parametrize("replaced", [False, True])
def test_passages_around_an_inserted_block(spark, replaced):
    r = random.Random(21)
    words = lambda n: [f"v{r.randint(0, 10 ** 6)}" for _ in range(n)]
    rows, marks = [], {}
    for i in range(0, 40, 2):
        left, right = words(r.randint(52, 58)), words(r.randint(52, 58))
        rows.append((i, " ".join(words(40) + left + (words(32) if replaced else []) + right + words(40))))
        rows.append((i + 1, " ".join(words(30) + left + words(32) + right + words(30))))
        marks[i + 1] = [(30, 30 + len(left)), (62 + len(left), 62 + len(left) + len(right))]
    found = passages.repeated_passages(spark.createDataFrame(rows, DOCUMENTS)).collect()
    for i, spans in marks.items():
        own = sorted((x["start"], x["start"] + x["n_words"], x["n_equal"]) for x in found if x["doc_id"] == i)
        assert [(b, e) for b, e, _ in own] == spans and all(n == e - b for b, e, n in own)


@pytest.mark.parametrize("seed", range(4))
def test_stretches_hold_every_agreeing_stretch(seed):
    r = random.Random(seed)
    own, its, i, j = [], [], 0, 0
    for _ in range(160):
        share = 0.97 if i // 30 % 2 else 0.6
        if r.random() < share:
            own.append(i)
            its.append(j)
        turn = r.random()
        i, j = i + (turn >= 0.05 or own[-1:] == [i]), j + (turn < 0.95 or its[-1:] == [j])
    own, its = np.array(own), np.array(its)
    enough = lambda b, e: (own[e] + 1 - own[b] >= 30 and e + 1 - b >= 0.8 * max(
        own[e] + 1 - own[b], its[e] + 1 - its[b]))
    found = passages.stretches(own, its, 30, 0.8)
    want = {m for b in range(len(own)) for e in range(b, len(own)) if enough(b, e) for m in range(b, e + 1)}
    assert want and all(enough(b, e) for b, e in found)
    assert {m for b, e in found for m in range(b, e + 1)} == want


def test_removal_of_passages(spark):
    schema = "doc_id bigint, text string, n_chars bigint, spans string"
    rows = [(1, "a b\n c  d e", 11, "x"), (2, "a b", 3, None), (3, None, None, None), (None, "z", 1, None),
            (4, "one  two", 8, None)]
    spans = spark.createDataFrame([(1, 1, 2), (1, 2, 2), (2, 0, 2), (3, 0, 9)],
                                  "doc_id bigint, start bigint, n_words bigint")
    got = sorted((tuple(r) for r in passages.without_passages(spark.createDataFrame(rows, schema), spans).collect()),
                 key=str)
    assert got == sorted([(1, "a  e", 4, "x"), (3, None, None, None), (None, "z", 1, None), (4, "one  two", 8, None)],
                         key=str)


def test_passages_edge_cases(spark):
    same = " ".join(f"w{i}" for i in range(70))
    rows = [(1, None), (2, ""), (3, "short " * 3), (4, same), (4, same), (5, same), (None, same), (6, "same " * 20_000)]
    got = passages.repeated_passages(spark.createDataFrame(rows, DOCUMENTS).withColumn("seed", F.lit("clash")))
    assert [tuple(r) for r in got.collect()] == [(5, 0, 70, 4, 0, 70, 70)]
    assert passages.repeated_passages(spark.createDataFrame([], DOCUMENTS)).count() == 0


def brute_chain(at, other, k, cost):
    best = []
    for i in range(len(at)):
        score = k
        for j in range(i):
            if at[j] < at[i] and other[j] < other[i]:
                added = min(k, at[i] - at[j], other[i] - other[j])
                score = max(score, best[j] - cost * (at[i] - at[j] + other[i] - other[j]) + added)
        best.append(score)
    return max(best)


@pytest.mark.parametrize("seed", range(5))
def test_chains_move_forward_in_both(seed):
    r = random.Random(seed)
    matches = sorted({(r.randint(0, 80), r.randint(0, 80)) for _ in range(60)})
    at, other = [m[0] for m in matches], [m[1] for m in matches]
    found = passages.chained(at, other, 6, 0.15, 10 ** 6)
    assert sorted(i for chain in found for i in chain) == list(range(len(matches)))
    for chain in found:
        assert all(at[a] < at[b] and other[a] < other[b] for a, b in zip(chain, chain[1:]))
    score = 6 + sum(min(6, at[b] - at[a], other[b] - other[a]) - 0.15 * (at[b] - at[a] + other[b] - other[a])
                    for a, b in zip(found[0], found[0][1:]))
    # the tree ranks by score and cost; the added words can differ by one step
    assert score >= brute_chain(at, other, 6, 0.15) - 6


def test_seeds_of_equal_passages_are_equal():
    r = np.random.default_rng(1)
    passage = r.integers(0, 2 ** 63, 60).astype(np.uint64)
    found = []
    for _ in range(5):
        words = np.concatenate((r.integers(0, 2 ** 63, 30).astype(np.uint64), passage,
                                r.integers(0, 2 ** 63, 30).astype(np.uint64)))
        values, at = passages.seeds_of(words, np.zeros(len(words), np.int64))
        inside = (at >= 30 + 15) & (at <= 90 - 6 - 15)
        found.append((values[inside].tolist(), (at[inside]).tolist()))
    assert all(f == found[0] for f in found) and found[0][0]
