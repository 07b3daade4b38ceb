import os
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewloom import plans
from reviewloom import streaming as st
from reviewloom.functions import marker_language
from reviewloom.operators import percentile_cut, top_n
from reviewloom.streaming.keyed import COUNTS, KEYS
from reviewloom.streaming.ledger import LEDGER

ROWS = ("client_id bigint, input string, batch_id bigint, row_no bigint, eof boolean, "
        "app_id bigint, name string, seq bigint, is_review boolean")


class Feed:
    """A folder of files, each of which is one micro-batch, in the order added."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.files = spark, folder, 0
        self.schema = T.StructType.fromDDL(schema)
        os.makedirs(folder / "in", exist_ok=True)

    def add(self, rows):
        path = self.folder / "in" / f"{self.files:04d}.parquet"
        table = pd.DataFrame(rows, columns=self.schema.fieldNames())
        for field in self.schema:
            if field.dataType == T.LongType():
                table[field.name] = table[field.name].astype("Int64")
            elif field.dataType == T.StringType():
                table[field.name] = table[field.name].astype("string")
        table.to_parquet(path, index=False)
        os.utime(path, (1_000_000 + self.files, 1_000_000 + self.files))
        self.files += 1

    def stream(self):
        reader = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1)
        return reader.parquet(str(self.folder / "in"))

    def path(self, name):
        return str(self.folder / name)


@pytest.fixture
def feed(spark, tmp_path):
    return Feed(spark, tmp_path, ROWS)


def batch(client, number, rows, eof=False, input="reviews"):
    """Rows (app_id, name or None, seq) of one batch; a name makes a catalogue row."""
    return [
        (client, input, number, i, eof, app, name, seq, name is None)
        for i, (app, name, seq) in enumerate(rows)
    ]


def review(app):
    return (app, None, 0)


SCRIPT = [
    batch(1, 0, [(7, "old", 1), review(7), review(7), review(8)])
    + batch(2, 0, [review(7), (7, "other", 1)]),
    batch(1, 1, [review(9), (8, "eight", 2), review(8)]),
    batch(1, 2, [(7, "new", 5), (9, "nine", 3), review(8), review(8)])
    + batch(2, 1, [review(5), review(7)], eof=True),
    batch(1, 3, [review(7), (6, "unreviewed", 1)], eof=True),
]
FINAL = [(1, 7, "new", 3), (1, 8, "eight", 4), (1, 9, "nine", 1), (2, 7, "other", 2)]


def accept(feed, **options):
    st.accept_new_batches(
        feed.stream(), feed.path("accepted"), feed.path("ledger"), feed.path("ck-accept"), **options
    )
    return st.log_view(feed.spark, feed.path("accepted"), feed.schema)


def ledger(feed):
    return st.log_view(feed.spark, feed.path("ledger"), LEDGER)


def counted(feed, name="counts"):
    st.start_log(feed.spark, feed.path(name), COUNTS)
    st.run_epochs(
        st.keyed_counts(feed.stream()), lambda rows, epoch: rows,
        feed.path(name), feed.path("ck-counts"), "update",
    )
    rows = st.latest(st.log_view(feed.spark, feed.path(name), COUNTS), KEYS, ["name", "stat"])
    rows = rows.filter("stat > 0 and coalesce(name, '') <> ''")
    return sorted(tuple(row) for row in rows.collect())


def test_counts_over_micro_batches(feed):
    for rows in SCRIPT:
        feed.add(rows)
    assert counted(feed) == FINAL


def test_counts_do_not_depend_on_order(feed):
    for rows in reversed(SCRIPT):
        feed.add(rows)
    assert counted(feed) == FINAL


def test_stream_equals_batch(feed):
    for rows in SCRIPT:
        feed.add(rows)
    whole = st.keyed_counts(feed.spark.read.schema(feed.schema).parquet(feed.path("in")))
    whole = whole.filter("stat > 0 and name is not null")
    assert sorted(tuple(row) for row in whole.collect()) == counted(feed)


def test_a_game_reviewed_only_in_the_last_batch_counts(feed):
    feed.add(batch(1, 0, [(7, "seven", 1), (8, "eight", 2), review(8)]))
    feed.add(batch(1, 1, [review(7)], eof=True))
    assert counted(feed) == [(1, 7, "seven", 1), (1, 8, "eight", 1)]


def test_restart_from_checkpoint(feed):
    """Stopping after every file and going on gives the uninterrupted answer."""
    for rows in SCRIPT:
        feed.add(rows)
        answer = counted(feed)
    assert answer == FINAL


def test_going_on_with_a_compacted_log(feed):
    for rows in SCRIPT[:3]:
        feed.add(rows)
    counted(feed)
    log = st.log_view(feed.spark, feed.path("counts"), COUNTS)
    st.compact_log(log, KEYS, ["name", "stat"], feed.path("compact"))
    compact = st.log_view(feed.spark, feed.path("compact"), COUNTS)
    assert compact.count() == log.select(*KEYS).distinct().count() < log.count()
    feed.add(SCRIPT[3])
    assert counted(feed, "compact") == FINAL


def test_going_on_with_a_compacted_answer(feed, spark):
    """A log of whole answers is compacted to its newest answer, and goes on."""
    schema = "client_id bigint, app_id bigint, name string, stat bigint, turn int"

    def turn(number, rows, log):
        frame = spark.createDataFrame([(*row, number) for row in rows], schema)
        frame.write.mode("append").parquet(feed.path("stats"))
        stream = spark.readStream.schema(schema).parquet(feed.path("stats")).drop("turn")
        st.run_top(stream, 2, feed.path(log), feed.path("ck-top"), growing=False)
        return sorted((r["app_id"], r["stat"]) for r in st.top_view(spark, feed.path(log)).collect())

    assert turn(0, [(1, 1, "a", 5), (1, 2, "b", 4), (1, 3, "c", 3)], "top") == [(1, 5), (2, 4)]
    assert turn(1, [(1, 4, "d", 6)], "top") == [(1, 5), (4, 6)]
    st.compact_top(spark, feed.path("top"), feed.path("short"))
    assert turn(2, [(1, 5, "e", 7), (1, 6, "f", 1)], "short") == [(4, 6), (5, 7)]


def test_a_failed_epoch_is_written_again(feed):
    """The output of a failed attempt is replaced, not added to."""
    for rows in SCRIPT:
        feed.add(rows)
    calls = []

    def handle(rows, epoch):
        calls.append(epoch)
        if calls.count(2) == 1 and epoch == 2:
            rows.write.mode("overwrite").parquet(f"{feed.path('log')}/epoch=2")
            raise RuntimeError("lost")
        return rows

    st.start_log(feed.spark, feed.path("log"), feed.schema)

    def run():
        st.run_epochs(feed.stream(), handle, feed.path("log"), feed.path("ck"))

    with pytest.raises(Exception, match="lost"):
        run()
    run()
    assert calls == [0, 1, 2, 2, 3]
    log = st.log_view(feed.spark, feed.path("log"), feed.schema)
    assert log.count() == sum(map(len, SCRIPT))


def test_repeated_batches_count_once(feed):
    for rows in (SCRIPT[0], SCRIPT[1], SCRIPT[1], SCRIPT[0] + SCRIPT[2], SCRIPT[2] + SCRIPT[2],
                 SCRIPT[3]):
        feed.add(rows)
    rows = accept(feed)
    assert rows.count() == sum(map(len, SCRIPT))
    counts = st.keyed_counts(rows).filter("stat > 0 and name is not null")
    assert sorted(tuple(row) for row in counts.collect()) == FINAL
    state = {row.client_id: row for row in st.completeness(ledger(feed)).collect()}
    assert state[1].complete and state[2].complete
    assert (state[1].last_batch, state[1].batches) == (3, 4)


def test_a_gap_is_open_until_it_is_filled(feed):
    for rows in (SCRIPT[0], SCRIPT[3], SCRIPT[1]):
        feed.add(rows)
    accept(feed)
    state = {row.client_id: row.complete for row in st.completeness(ledger(feed)).collect()}
    assert state == {1: False, 2: False}
    gaps = [tuple(row) for row in st.missing_batches(ledger(feed)).collect()]
    assert gaps == [(1, "reviews", 2)]
    feed.add(SCRIPT[2])
    accept(feed)
    state = {row.client_id: row.complete for row in st.completeness(ledger(feed)).collect()}
    assert state == {1: True, 2: True}
    assert st.missing_batches(ledger(feed)).count() == 0


def test_gaps_over_several_blocks(spark):
    missing = {0, 4095, 4096, 9000, *range(12_000, 17_000)}
    present = [n for n in range(20_000) if n not in missing]
    rows = spark.createDataFrame([(1, "a", n) for n in present],
                                 "client_id bigint, input string, batch_id bigint")
    got = sorted(row.batch_id for row in st.missing_batches(rows).collect())
    assert got == sorted(missing)


def test_first_delivery(spark):
    rows = [(1, "a", 0, 10, "x"), (1, "a", 0, 10, "y"), (1, "a", 0, 12, "late"),
            (1, "a", 1, 13, "z"), (2, "a", 0, 12, "other"), (1, "b", 0, 12, "input")]
    frame = spark.createDataFrame(
        rows, "client_id bigint, input string, batch_id bigint, arrival bigint, v string")
    kept = st.first_delivery(frame, "arrival")
    assert kept.columns == frame.columns
    assert sorted(row.v for row in kept.collect()) == ["input", "other", "x", "y", "z"]


def test_once(spark):
    rows = [(1, "a", 0, 0, "x"), (1, "a", 0, 1, "y"), (1, "a", 0, 0, "x"), (1, "a", 0, 1, "y"),
            (1, "a", 1, 0, "z"), (2, "a", 0, 0, "x")]
    frame = spark.createDataFrame(
        rows, "client_id bigint, input string, batch_id bigint, row_no bigint, v string")
    assert sorted(map(tuple, st.once(frame).collect())) == sorted(set(rows))


def test_senders(spark):
    rows = [(1, 1), (1, 2), (1, 2), (1, 3), (2, 1), (2, 1)]
    frame = spark.createDataFrame(rows, "client_id bigint, sender int")
    got = {row.client_id: (row.reported, row.complete)
           for row in st.senders_complete(frame, 3).collect()}
    assert got == {1: (3, True), 2: (1, False)}


def test_running_top(feed):
    for rows in SCRIPT:
        feed.add(rows)
    st.run_top(st.keyed_counts(feed.stream()), 2, feed.path("top"), feed.path("ck-top"))
    got = sorted(tuple(row) for row in st.top_view(feed.spark, feed.path("top")).collect())
    whole = st.keyed_counts(feed.spark.read.schema(feed.schema).parquet(feed.path("in")))
    want = sorted(tuple(row) for row in top_n(whole, 2, by=("client_id",)).collect())
    assert got == want
    assert [row[:2] for row in got] == [(1, 7), (1, 8), (2, 5), (2, 7)]


def test_running_top_many_batches(spark, tmp_path):
    feed = Feed(spark, tmp_path, ROWS)
    for i in range(6):
        feed.add(batch(1, i, [review((i * j) % 11) for j in range(1, 30)]))
    st.run_top(st.keyed_counts(feed.stream()), 3, feed.path("top"), feed.path("ck"))
    whole = st.keyed_counts(spark.read.schema(feed.schema).parquet(feed.path("in")))
    want = [tuple(r) for r in top_n(whole, 3).select("app_id", "stat").collect()]
    got = st.top_view(spark, feed.path("top")).orderBy(F.desc("stat"), "app_id")
    assert [(r.app_id, r.stat) for r in got.collect()] == want


def test_percentile_waits_for_complete_tenants(feed):
    for rows in SCRIPT[:3]:
        feed.add(rows)

    def answer():
        accept(feed)
        complete = st.completeness(ledger(feed)).filter("complete")
        found = st.run_percentile(
            st.keyed_counts(feed.stream()), 50, feed.path("p"), feed.path("ck-p"), complete
        )
        return sorted(tuple(row) for row in found.collect())

    assert answer() == [(2, 7, "other", 2)]
    feed.add(SCRIPT[3])
    assert answer() == [(1, 7, "new", 3), (1, 8, "eight", 4), (2, 7, "other", 2)]
    whole = feed.spark.createDataFrame(FINAL, COUNTS)
    want = percentile_cut(whole, 50, by=("client_id",))
    assert sorted(tuple(row) for row in want.collect()) == answer()


def test_flags(feed):
    for rows in SCRIPT:
        feed.add(rows)
    flags = {"reviews": F.col("is_review"), "names": ~F.col("is_review")}
    schema = T.StructType.fromDDL("client_id bigint, reviews bigint, names bigint")
    st.start_log(feed.spark, feed.path("f"), schema)
    st.run_epochs(st.running_flags(feed.stream(), flags), lambda rows, epoch: rows,
                  feed.path("f"), feed.path("ck-f"), "update")
    rows = st.latest(st.log_view(feed.spark, feed.path("f"), schema), ["client_id"], list(flags))
    assert sorted(tuple(row) for row in rows.collect()) == [(1, 8, 5), (2, 3, 1)]


def test_progress_and_finish(feed):
    for rows in SCRIPT[:3]:
        feed.add(rows)

    def answer():
        accept(feed)
        results = st.progress(st.keyed_counts(feed.stream()), 1, feed.path("r"), feed.path("ck-r"))
        done = st.completeness(ledger(feed)).filter("complete")
        rows = st.with_finish_rows(results, done).collect()
        return sorted((r.client_id, r.app_id or 0, r.stat or 0, r.finished) for r in rows)

    assert answer() == [(1, 7, 2, False), (1, 8, 4, False), (2, 0, 0, True), (2, 7, 2, False)]
    feed.add(SCRIPT[3])
    assert answer() == [(1, 0, 0, True), (1, 7, 3, False), (1, 8, 4, False), (2, 0, 0, True),
                        (2, 7, 2, False)]
    emitted = st.log_view(feed.spark, feed.path("r"), COUNTS)
    assert emitted.filter("client_id = 1 and app_id = 8").count() > 1


def test_first_result(spark):
    rows = [(1, 3, 5, "late"), (1, 3, 2, "first"), (1, 4, 9, "only"), (2, 3, 1, "own")]
    frame = spark.createDataFrame(rows, "client_id bigint, query_no int, arrival int, v string")
    got = sorted(tuple(row) for row in st.first_result(frame, "arrival").collect())
    assert got == [(1, 3, 2, "first"), (1, 4, 9, "only"), (2, 3, 1, "own")]


def test_first_results_of_a_stream(spark, tmp_path):
    feed = Feed(spark, tmp_path, "client_id bigint, query_no bigint, arrival bigint, v string")
    feed.add([(1, 3, 5, "kept"), (1, 3, 6, "no")])
    feed.add([(1, 3, 1, "too late"), (1, 4, 9, "other"), (2, 3, 8, "no"), (2, 3, 7, "own")])
    feed.add([(1, 4, 10, "repeat")])
    got = st.run_first_results(feed.stream(), "arrival", feed.path("log"), feed.path("ck"))
    assert sorted((r.client_id, r.query_no, r.v) for r in got.collect()) == [
        (1, 3, "kept"), (1, 4, "other"), (2, 3, "own")
    ]


@pytest.fixture
def tenants(spark):
    return spark.createDataFrame([(c, v) for c in (1, 2, 3) for v in "ab"],
                                 "client_id bigint, v string")


def control(spark, *rows):
    return spark.createDataFrame(list(rows), "action string, client_id bigint")


@pytest.mark.parametrize("rows, left", [
    ([("one", 2)], [1, 3]),
    ([("upto", 2)], [3]),
    ([("upto", 1), ("one", 3), ("upto", 0)], [2]),
    ([], [1, 2, 3]),
])
def test_purge(spark, tenants, tmp_path, rows, left):
    table = control(spark, *rows)
    assert sorted(r.client_id for r in st.live_rows(tenants, table).collect()) == sorted(left * 2)
    purged = sorted(r.client_id for r in st.purged_ids(tenants.distinct(), table).collect())
    assert purged == sorted({1, 2, 3} - set(left))
    st.rewrite_without(tenants, table, str(tmp_path / "t"))
    folders = sorted(path.name for path in (tmp_path / "t").glob("client_id=*"))
    assert folders == [f"client_id={c}" for c in left]


def test_late_rows_of_done_tenants(feed):
    for rows in SCRIPT:
        feed.add(rows)
    done = feed.spark.createDataFrame([(1,)], "client_id bigint")
    log = feed.path("live")
    st.handle_batches(feed.stream(), lambda rows: st.drop_done(rows, done), feed.schema, log,
                      feed.path("ck-live"))
    rows = st.log_view(feed.spark, log, feed.schema)
    assert {row.client_id for row in rows.collect()} == {2}


def test_tenants_are_isolated(feed):
    """Purging one tenant leaves the answers of the others as they were."""
    for rows in SCRIPT:
        feed.add(rows)
    live = st.live_rows(accept(feed), control(feed.spark, ("one", 1)))
    counts = st.keyed_counts(live).filter("stat > 0 and name is not null")
    assert sorted(tuple(row) for row in counts.collect()) == [r for r in FINAL if r[0] == 2]


def test_stateful_handler_over_micro_batches(feed):
    for rows in SCRIPT:
        feed.add(rows)

    def handler(state, rows):
        heads = int((rows["row_no"] == 0).sum())
        state = (state[0] + heads, state[1] + len(rows))
        return state, state

    handled = st.stateful_handlers(
        feed.stream(), handler, (0, 0),
        output="batches bigint, n bigint", state="batches bigint, n bigint", lanes=2,
    )
    schema = handled.schema
    st.start_log(feed.spark, feed.path("s"), schema)
    st.run_epochs(handled, lambda rows, epoch: rows, feed.path("s"), feed.path("ck-s"), "update")
    lanes = st.latest(st.log_view(feed.spark, feed.path("s"), schema), ["client_id", "lane"],
                      ["batches", "n"])
    rows = lanes.groupBy("client_id").agg(F.sum("batches"), F.sum("n")).collect()
    assert sorted(map(tuple, rows)) == [(1, 4, 13), (2, 2, 4)]


GAME_ROWS = ("client_id bigint, app_id bigint, name string, seq bigint, release_year bigint, "
             "avg_playtime bigint, linux boolean, mac boolean, windows boolean, genre string")
REVIEW_ROWS = "client_id bigint, app_id bigint, text string, score bigint"


def test_questions_over_streams_equal_the_batch(spark, tmp_path):
    """Random tenants, in several micro-batches of either input, asked after each."""
    pick = random.Random(21)
    game_feed = Feed(spark, tmp_path / "games", GAME_ROWS)
    review_feed = Feed(spark, tmp_path / "reviews", REVIEW_ROWS)
    texts = ["the cat is here", "el gato de la casa", "xyz"]

    def games_of(rows):
        return rows.withColumn("genres", F.split("genre", ",")).drop("genre")

    english = marker_language("text") == "en"
    seq = 0
    for step in range(3):
        rows = []
        for _ in range(15):
            seq += 1
            rows.append((
                pick.randint(1, 3), pick.randint(1, 25), f"name {seq}", seq,
                pick.choice([2009, 2010, 2015, 2020]), seq, pick.random() < 0.5,
                pick.random() < 0.2, True, pick.choice(["Indie", "Action", "Indie,Action", "RPG"]),
            ))
        game_feed.add(rows)
        review_feed.add([
            (pick.randint(1, 3), pick.randint(1, 30), pick.choice(texts),
             pick.choice([1, 1, -1, 0]))
            for _ in range(400)
        ])
        games = games_of(game_feed.stream())
        reviews = review_feed.stream()
        stored_games = games_of(spark.read.schema(game_feed.schema).parquet(game_feed.path("in")))
        stored_reviews = spark.read.schema(review_feed.schema).parquet(review_feed.path("in"))
        both = (stored_games, stored_reviews)
        by = ("client_id",)

        def folder(name):
            return str(tmp_path / name)

        def same(got, want):
            columns = want.columns
            assert sorted(map(tuple, got.select(*columns).collect())) == sorted(
                map(tuple, want.collect()))
            assert want.count() > 0

        same(st.stream_platform_counts(games, folder("q1")),
             plans.platform_counts(stored_games, by))
        same(st.stream_top_playtime(games, folder("q2"), n=3),
             plans.top_playtime(stored_games, n=3, by=by))
        same(st.stream_top_reviewed(games, reviews, folder("q3"), n=2),
             plans.top_reviewed(*both, n=2, seq="seq", by=by))
        same(st.stream_over_threshold(games, reviews, folder("q4"), n=0, in_language=english),
             plans.over_threshold(*both, n=0, in_language=english, seq="seq", by=by))
        same(st.stream_percentile_question(games, reviews, folder("q5"), p=60),
             plans.percentile_question(*both, p=60, seq="seq", by=by))


def test_long_gaps_are_ranges(spark):
    rows = spark.createDataFrame([(1, "a", n) for n in (0, 1, 4, 4096, 10 ** 13)] + [(2, "a", 2)],
                                 "client_id bigint, input string, batch_id bigint")
    got = sorted(tuple(r) for r in st.missing_ranges(rows).collect())
    assert got == [(1, "a", 2, 3), (1, "a", 5, 4095), (1, "a", 4097, 10 ** 13 - 1), (2, "a", 0, 1)]


def test_a_purge_travels_through_all_stages(spark, tmp_path):
    """State, logs and ledger of a tenant go, rows of the same batch and later ones too; others' files stay."""
    feed = Feed(spark, tmp_path / "rows", ROWS)
    purges = Feed(spark, tmp_path / "control", "action string, client_id bigint")
    purges.add([])
    for rows in SCRIPT[:2]:
        feed.add(rows)

    def work():
        control = purges.stream()
        st.accept_new_batches(
            feed.stream(), feed.path("accepted"), feed.path("ledger"), feed.path("ck-a"), control=control)
        st.run_purged(
            st.tenant_counts(feed.stream(), 2, control), lambda rows, epoch: rows.select(*COUNTS.fieldNames()),
            feed.path("counts"), feed.path("ck-c"), mode="update")

    def files():
        logs = ("accepted", "ledger", "counts")
        return {str(path): path.stat().st_mtime_ns for log in logs
                for path in (tmp_path / "rows" / log).glob("epoch=*/client_id=2/*.parquet")}

    def tenants(log, schema):
        return {row.client_id for row in st.written_view(spark, feed.path(log), schema).collect()}

    work()
    before = files()
    assert before and tenants("accepted", feed.schema) == {1, 2}
    purges.add([("one", 1)])
    feed.add(SCRIPT[2])
    work()
    feed.add(SCRIPT[3])
    work()
    for log, schema in (("accepted", feed.schema), ("ledger", LEDGER), ("counts", COUNTS)):
        assert tenants(log, schema) == {2}
        assert not list((tmp_path / "rows" / log).glob("epoch=*/client_id=1"))
    assert {row.client_id for row in st.state_rows(spark, feed.path("ck-c"), "games").select(
        "key.client_id").collect()} == {2}
    assert before.items() <= files().items()
    counts = st.latest(st.written_view(spark, feed.path("counts"), COUNTS), KEYS, ["name", "stat"])
    assert sorted(tuple(row) for row in counts.filter("stat > 0").collect()) == [r for r in FINAL if r[0] == 2]


def test_purge_marks(spark):
    marks = st.purge_marks(control(spark, ("one", 7), ("upto", 2), ("upto", 0), ("other", 5), ("one", None)))
    assert sorted((row.client_id for row in marks.collect()), key=str) == [1, 2, 7, None]


class Alarm:
    """Counts rows, and gives the count again when its timer expires."""

    def rows(self, key, frames, state):
        n = sum(map(len, frames)) + (state.n.get()[0] if state.n.exists() else 0)
        state.n.update((n,))
        state.timer(state.now() + 1)
        yield n, False

    def expired(self, key, at, state):
        yield state.n.get()[0], True


def test_timers(feed):
    feed.add(SCRIPT[0])
    feed.add(batch(9, 0, [review(1)]))
    out = st.tenant_states(feed.stream(), Alarm(), "n bigint, late boolean", values={"n": "n bigint"}, lanes=1,
                           columns=["app_id"], timers=True)
    schema = T.StructType.fromDDL("client_id bigint, n bigint, late boolean")
    st.start_log(feed.spark, feed.path("t"), schema)
    query = st.run_epochs(out, lambda rows, epoch: rows.select("client_id", "n", "late"), feed.path("t"),
                          feed.path("ck-t"), "update", every="100 milliseconds")
    want = {(1, 4, False), (2, 2, False), (1, 4, True), (2, 2, True), (9, 1, True)}
    got = set()
    for _ in range(60):
        if want <= got or not query.isActive:
            break
        time.sleep(1)
        got = {tuple(r) for r in st.written_view(feed.spark, feed.path("t"), schema).drop("epoch").collect()}
    query.stop()
    assert want <= got


def test_lanes_follow_the_load(spark):
    rows = spark.createDataFrame([(1,)] * 25 + [(2,)] * 3, "client_id bigint")
    lanes = st.measured_lanes(rows, per_lane=2)
    assert sorted(map(tuple, lanes.collect())) == [(1, 13), (2, 2)]
    known = spark.createDataFrame([(2, 9), (3, 1)], "client_id bigint, lanes int")
    assert sorted(map(tuple, st.measured_lanes(rows, 2, known, most=10).collect())) == [(1, 10), (2, 9), (3, 1)]


def test_lanes_are_not_capped(spark):
    """A tenant has a lane for every ``per_lane`` rows, however many these are."""
    rows = spark.range(30_001).select(F.lit(1).cast("bigint").alias("client_id"))
    assert list(map(tuple, st.measured_lanes(rows, per_lane=3).collect())) == [(1, 10_001)]


def test_game_counts_call_the_state_by_blocks():
    """A call of the state costs far more than a game, so there are a few for a thousand games."""
    held, calls = {}, []

    class Games:
        def getValue(self, key):
            calls.append(key)
            return held.get(key)

        def updateValue(self, key, value):
            calls.append(key)
            held[key] = value

    class State:
        games = Games()

    def frame(apps, names=None):
        return pd.DataFrame({"app_id": apps, "name": names, "seq": 0, "is_review": names is None})

    apps = list(range(1000))
    for turn in (1, 2):
        frames = [frame(apps), frame([*apps, 7], [*map(str, apps), "x"]), frame(apps[::-1])]
        out = sorted(st.GameCounts().rows((1, 0), iter(frames), State()))
        assert out == [(a, "x" if a == 7 else str(a), 2 * turn - 2, 2 * turn) for a in apps]
    assert len(calls) <= 16


def test_ranks_with_rows_that_lack_numbers(feed):
    """A name without a ``seq`` is older than any with one; a number above 2**53 stays what it is."""
    large = (1 << 60) + 1
    feed.add(batch(1, 0, [(7, "seven", None), review(7), (large, "large", 2), review(large)]))
    feed.add(batch(1, 1, [(None, "none", 4), review(None), (7, "first", 1)]))
    feed.add(batch(1, 2, [(large, "larger", 3), review(9)]))
    got = st.run_histograms(feed.stream(), feed.path("ranks"), lanes=2, p=0)
    assert sorted(map(tuple, got.collect())) == [(1, 7, "first", 1), (1, large, "larger", 1)]


def test_ranks_are_kept_up_to_date(feed):
    """After each file the answer equals the percentile of all counts so far, a purge included."""
    control = Feed(feed.spark, feed.folder / "control", "action string, client_id bigint")
    control.add([])
    folder = feed.path("ranks")
    files = [*SCRIPT, batch(3, 0, [(5, "five", 1), review(5), (5, "", 2)])]
    for step, rows in enumerate(files):
        feed.add(rows)
        if step == 3:
            control.add([("one", 2)])
        got = st.run_histograms(feed.stream(), folder, lanes=2, control=control.stream(), p=50)
        whole = st.keyed_counts(feed.spark.read.schema(feed.schema).parquet(feed.path("in")))
        whole = whole.filter("stat > 0 and coalesce(name, '') <> ''")
        if step >= 3:
            whole = whole.filter("client_id <> 2")
        want = percentile_cut(whole, 50, by=("client_id",))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert len(list((feed.folder / "ranks" / "histograms").glob("epoch=*"))) <= 3


def test_a_long_log_is_compacted_by_itself(feed):
    """Folders that are read stay few, and the newest versions stay what they are."""
    counts = st.keyed_counts(feed.stream())
    st.start_log(feed.spark, feed.path("log"), COUNTS)
    for i in range(14):
        feed.add(batch(1, i, [(i % 3, f"name {i}", i), review(i % 3)]))
    st.run_epochs(counts, lambda rows, epoch: rows, feed.path("log"), feed.path("ck"), "update", keys=KEYS,
                  compact_every=4)
    assert st.epochs_of(feed.spark, feed.path("log")) == [11, 12, 13]
    assert len(list((feed.folder / "log").glob("epoch=*"))) <= 7
    got = st.latest(st.written_view(feed.spark, feed.path("log"), COUNTS), KEYS, ["name", "stat"])
    assert sorted(map(tuple, got.collect())) == [(1, 0, "name 12", 5), (1, 1, "name 13", 5), (1, 2, "name 11", 4)]


def test_a_question_left_running(feed):
    """Answers on the way, a stop, files while it stands, and the batch answer after going on."""
    def ask():
        return st.progress(st.keyed_counts(feed.stream()), 1, feed.path("r"), feed.path("ck-r"), every="200 milliseconds")

    def answer(running):
        return sorted((r.client_id, r.app_id, r.stat) for r in running.catch_up().answer().collect())

    feed.add(SCRIPT[0])
    running = ask()
    assert answer(running) == [(1, 7, 2)]
    feed.add(SCRIPT[1])
    assert answer(running) == [(1, 7, 2), (1, 8, 2)]
    running.stop()
    feed.add(SCRIPT[2])
    running = ask()
    feed.add(SCRIPT[3])
    assert answer(running) == [(1, 7, 3), (1, 8, 4), (2, 7, 2)]
    running.stop()
