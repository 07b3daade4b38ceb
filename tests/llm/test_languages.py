"""Language identification: sums over segmentations, held-out accuracy, edge cases."""

import itertools

import numpy as np

from reviewloom.llm import languages, queries

SF_DIR = "/root/testdata/sf0.01"
SCHEMA = "doc_id bigint, text string, lang string"


def test_forward_sums_all_segmentations():
    pieces = [b" ", b"a", b"b", b"ab", b" a", b"ba", b"aba"]
    probability = np.random.default_rng(1).random((len(pieces), 2))
    table = languages.Pieces(pieces)
    word = b" ababa"
    numbers = table.of_words(np.frombuffer(word, np.uint8)[None, :])
    padded = np.vstack([probability, np.zeros(2)])
    total = languages.forward(numbers, padded)[0, -1]
    want = np.zeros(2)
    for cuts in itertools.product((0, 1), repeat=len(word) - 1):
        edges = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(word)]
        parts = [word[a:b] for a, b in zip(edges, edges[1:])]
        if all(p in pieces for p in parts):
            want += np.prod([probability[pieces.index(p)] for p in parts], axis=0)
    assert np.allclose(total, want)
    assert np.allclose(languages.backward(numbers, padded)[0, 0], want)


def test_scaling_cancels():
    pieces = [b" ", b"a", b"b", b"ab", b" a", b"ba", b"aba"]
    probability = np.random.default_rng(2).random((len(pieces), 2))
    rows = np.frombuffer(b" ababa", np.uint8)[None, :]
    numbers = languages.Pieces(pieces).of_words(rows)
    plain = languages.forward(numbers, np.vstack([probability, np.zeros(2)]))[0, -1]
    large = languages.forward(numbers, languages.scaled(pieces, probability))[0, -1]
    assert np.allclose(np.log(large) - rows.shape[1] * np.log(languages.SCALE), np.log(plain))


def test_words_of_rare_bytes_keep_a_probability():
    pieces = languages.vocabulary()
    assert max(map(len, pieces)) > 40  # none is left out
    probability = np.full((len(pieces), 2), 3e-11)
    probability[:, 1] = 3e-10
    scorer = languages.Scorer(pieces, probability)
    data = np.frombuffer("ⴰⴱⵎⴷ".encode() * 4 + b"x" * 40, np.uint8)[:43]
    scores, at = scorer.words(data, np.array([0]), np.array([len(data)]))
    assert np.isfinite(scores).all() and scores[at[0], 1] > scores[at[0], 0]


def test_long_words_are_cut_where_characters_begin():
    for text in ("жук" * 100, "ⴰⴱⵎ" * 77, "x𐍈" * 60, "a" * 41, "é" * 20, "ab c" + "日本" * 50 + " d"):
        data = np.frombuffer(text.encode(), np.uint8)
        starts, ends, owners = languages.letter_words(data, np.array([0, len(data)]))
        raw = data.tobytes()
        words = [raw[a:b].decode() for a, b in zip(starts, ends)]  # fails if a character is cut
        assert "".join(words) == text.replace(" ", "")
        assert 0 < min(ends - starts) and max(ends - starts) <= languages.LONGEST_WORD + 3
        assert not owners.any()


def test_a_long_word_of_an_unseen_script(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr")] * 50
    model = languages.fit(spark.createDataFrame(rows, SCHEMA))
    letters = np.random.default_rng(3).integers(0x2D30, 0x2D68, 1_700_000)
    text = "".join(map(chr, letters))
    got = languages.predict(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), model).first()
    assert got["lang_pred"] in ("en", "fr") and 0 <= got["score"] <= 1


def test_held_out_accuracy(spark):
    gold = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    found = queries.QUERIES["op2_language_id"](spark, SF_DIR).collect()
    assert sorted(r["doc_id"] for r in found) == sorted(gold)
    held = [r for r in found if r["held_out"]]
    assert 200 < len(held) < 450
    assert np.mean([r["lang_pred"] == gold[r["doc_id"]] for r in held]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in found)


def test_edge_cases(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"), (3, None, "en"), (4, "a", None)] * 3
    model = languages.fit(spark.createDataFrame(rows, SCHEMA), sample_texts=100)
    assert model[0] == ["en", "fr"]
    texts = [(1, None), (2, ""), (3, "123 !?"), (4, "“”"), (5, "the dog"), (6, "le chien"), (None, "the"),
             (8, "x" * 300_000), (9, "the " * 300_000), (5, "the dog"), (10, "жук")]
    frame = spark.createDataFrame([(i, t, "old", 0.5) for i, t in texts],
                                  "doc_id bigint, text string, lang_pred string, score double")
    got = [tuple(r) for r in languages.predict(frame, model).collect()]
    assert len(got) == len(texts)
    by_id = {r[0]: r[2:] for r in got}
    assert all(by_id[i] == ("und", 0.0) for i in (1, 2, 3, 4))
    assert by_id[5][0] == by_id[None][0] == by_id[9][0] == "en" and by_id[6][0] == "fr"
    assert by_id[8][0] in ("en", "fr") and by_id[10][0] in ("en", "fr")


def test_nothing_labelled(spark):
    model = languages.fit(spark.createDataFrame([(1, "a", None)], SCHEMA))
    got = languages.predict(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"), model).collect()
    assert [tuple(r) for r in got] == [(1, "a", "und", 0.0)]
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert languages.predict(empty, model).count() == 0
