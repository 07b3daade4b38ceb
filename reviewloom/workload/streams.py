"""Streaming queries over the events, as a file stream that ends.

Each runs the stream to its end into a table in the shared folder and returns the
table; the SQL gives the batch answer.
"""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import streaming as st
from ..session import shared_dir, stored
from ..streaming.keyed import COUNTS, KEYS
from ..streaming.ledger import LEDGER
from .registry import query
from .tables import (
    EVENT_ROWS_SQL,
    TENANTS_SQL,
    load,
    load_stream,
    stored_event_rows,
    streamed_event_rows,
    tenant_games,
    tenant_reviews,
)
from .tenants import (
    FIRST_RESULT_SQL,
    TENANT_OVER_SQL,
    TENANT_PERCENTILE_SQL,
    TENANT_PLATFORMS_SQL,
    TENANT_PLAYTIME_SQL,
    TENANT_TOP_SQL,
    results,
)

COUNTS_SQL = f"""
WITH {EVENT_ROWS_SQL}, stats AS (
  SELECT client_id, app_id, arg_max(props, seq) FILTER (input = 'signup') AS name,
         count(*) FILTER (input = 'error') AS stat
  FROM event_rows WHERE input IN ('signup', 'error') GROUP BY client_id, app_id),
live AS (SELECT * FROM stats WHERE stat > 0 AND coalesce(name, '') <> '')"""


def _tagged(spark, sf_dir):
    """Signups name a game, errors are its reviews."""
    rows = streamed_event_rows(spark, sf_dir).filter(F.col("input").isin("signup", "error"))
    return rows.select(
        *KEYS, F.col("props").alias("name"), "seq", (F.col("input") == "error").alias("is_review")
    )


def _run(spark, label, stream, schema, handle, mode):
    """Run to the end; return the epoch log."""
    folder = shared_dir(spark, label)
    st.start_log(spark, f"{folder}/log", schema)
    st.run_epochs(stream, handle, f"{folder}/log", f"{folder}/checkpoint", mode)
    return st.log_view(spark, f"{folder}/log", schema)


@query("stream_counts", f"{COUNTS_SQL} SELECT * FROM live")
def stream_counts(spark, sf_dir):
    counts = st.keyed_counts(_tagged(spark, sf_dir))
    log = _run(spark, "counts", counts, COUNTS, lambda rows, epoch: rows, "update")
    return st.latest(log, KEYS, ["name", "stat"]).filter("stat > 0 and coalesce(name, '') <> ''")


@query("stream_flags", f"""
WITH {EVENT_ROWS_SQL}
SELECT client_id, count(*) FILTER (input = 'click') AS clicks,
       count(*) FILTER (input = 'view') AS views,
       count(*) FILTER (input = 'purchase') AS purchases
FROM event_rows GROUP BY client_id""")
def stream_flags(spark, sf_dir):
    flags = {
        "clicks": F.col("input") == "click",
        "views": F.col("input") == "view",
        "purchases": F.col("input") == "purchase",
    }
    running = st.running_flags(streamed_event_rows(spark, sf_dir), flags)
    schema = T.StructType([
        T.StructField(name, T.LongType()) for name in ("client_id", *flags)
    ])
    log = _run(spark, "flags", running, schema, lambda rows, epoch: rows, "update")
    return st.latest(log, ["client_id"], list(flags))


@query("stream_top", f"""{COUNTS_SQL}
SELECT client_id, app_id, stat FROM stats
QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY stat DESC, app_id) <= 3""")
def stream_top(spark, sf_dir):
    folder = shared_dir(spark, "top")
    counts = st.keyed_counts(_tagged(spark, sf_dir))
    st.run_top(counts, 3, f"{folder}/log", f"{folder}/checkpoint")
    return st.top_view(spark, f"{folder}/log").drop("name")


@query("stream_percentile", f"""{COUNTS_SQL}, placed AS (
  SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY stat, app_id DESC) AS place,
         count(*) OVER (PARTITION BY client_id) AS n
  FROM live)
SELECT client_id, app_id, name, stat FROM placed
WHERE place > greatest(0, CAST(ceil(CAST(90 AS DOUBLE) / 100 * n) AS BIGINT) - 1)""")
def stream_percentile(spark, sf_dir):
    folder = shared_dir(spark, "percentile")
    counts = st.keyed_counts(_tagged(spark, sf_dir))
    return st.run_percentile(counts, 90, f"{folder}/log", f"{folder}/checkpoint")


@query("stream_dedup", f"""
WITH {EVENT_ROWS_SQL} SELECT client_id, input, batch_id, row_no, value FROM event_rows""")
def stream_dedup(spark, sf_dir):
    """Every batch comes twice; each is accepted once."""
    columns = ["client_id", "input", "batch_id", "row_no", "eof", "value"]
    twice = [streamed_event_rows(spark, sf_dir).select(*columns) for _ in range(2)]
    folder = shared_dir(spark, "dedup")
    stream = twice[0].unionByName(twice[1])
    st.accept_new_batches(
        stream, f"{folder}/accepted", f"{folder}/ledger", f"{folder}/checkpoint"
    )
    accepted = st.log_view(spark, f"{folder}/accepted", stream.schema)
    return accepted.drop("epoch", "eof")


@query("stream_dedup_split", f"""
WITH {EVENT_ROWS_SQL} SELECT client_id, input, batch_id, row_no, value FROM event_rows""")
def stream_dedup_split(spark, sf_dir):
    """Every batch comes in two parts, in runs of their own, and then whole again."""
    columns = ["client_id", "input", "batch_id", "row_no", "eof", "value"]
    folder = shared_dir(spark, "dedup-split")
    for turn, part in enumerate(("row_no % 2 = 0", "row_no % 3 = 0", "true")):
        stream = streamed_event_rows(spark, sf_dir).select(*columns).filter(part)
        st.accept_new_batches(
            stream, f"{folder}/accepted", f"{folder}/ledger", f"{folder}/checkpoint-{turn}",
            first_epoch=turn * 1000)
    accepted = st.log_view(spark, f"{folder}/accepted", stream.schema)
    return accepted.drop("epoch", "eof")


@query("stream_first_result", FIRST_RESULT_SQL)
def stream_first_result(spark, sf_dir):
    folder = shared_dir(spark, "first")
    stream = results(streamed_event_rows(spark, sf_dir))
    return st.run_first_results(stream, "seq", f"{folder}/log", f"{folder}/checkpoint")


@query("stream_progress", f"""{COUNTS_SQL}, numbers AS (
  SELECT client_id, max(batch_id) AS last_batch, count(DISTINCT batch_id) AS batches,
         bool_or(eof) AS eof
  FROM event_rows GROUP BY client_id)
SELECT client_id, app_id, name, stat, false AS finished FROM stats WHERE stat > 15
UNION ALL
SELECT client_id, NULL, NULL, NULL, true FROM numbers WHERE eof AND batches = last_batch + 1""")
def stream_progress(spark, sf_dir):
    """Games over the threshold, and a finish row per tenant that is complete."""
    folder = shared_dir(spark, "progress")
    counts = st.keyed_counts(_tagged(spark, sf_dir))
    results = st.progress(counts, 15, f"{folder}/log", f"{folder}/checkpoint")

    numbers = streamed_event_rows(spark, sf_dir).select(
        "client_id", F.lit("events").alias("input"), "batch_id", "eof"
    )
    ledger = _run(
        spark, "numbers", numbers, LEDGER, lambda rows, epoch: rows.distinct(), "append"
    )
    state = st.completeness(ledger)
    return st.with_finish_rows(results, state.filter("complete"))


@query("stream_handler", f"""
WITH {EVENT_ROWS_SQL}
SELECT client_id, input, count(*) AS n, max(value) AS top
FROM event_rows GROUP BY client_id, input""")
def stream_handler(spark, sf_dir):
    """A user function per micro-batch: Arrow-batched Python, then a partial sum."""
    def handler(rows):
        def strongest(frames):
            for frame in frames:
                grouped = frame.groupby(["client_id", "input"])["value"]
                yield grouped.agg(n="count", top="max").reset_index()

        partial = rows.select("client_id", "input", "value").mapInPandas(
            strongest, "client_id bigint, input string, n bigint, top double"
        )
        return partial.groupBy("client_id", "input").agg(
            F.sum("n").alias("n"), F.max("top").alias("top")
        )

    schema = T.StructType([
        T.StructField("client_id", T.LongType()),
        T.StructField("input", T.StringType()),
        T.StructField("n", T.LongType()),
        T.StructField("top", T.DoubleType()),
    ])
    folder = shared_dir(spark, "handler")
    st.handle_batches(
        streamed_event_rows(spark, sf_dir), handler, schema,
        f"{folder}/log", f"{folder}/checkpoint",
    )
    log = st.log_view(spark, f"{folder}/log", schema)
    return log.groupBy("client_id", "input").agg(F.sum("n").alias("n"), F.max("top").alias("top"))


@query("stream_stateful_user", f"""
WITH {EVENT_ROWS_SQL}
SELECT client_id, count(*) AS n, max(batch_id) AS last_batch FROM event_rows GROUP BY client_id""")
def stream_stateful_user(spark, sf_dir):
    """A user handler that keeps, per tenant, the rows seen and the last batch."""
    def handler(state, rows):
        seen, last = state
        state = (seen + len(rows), max(last, int(rows["batch_id"].max())))
        return state, state

    folder = shared_dir(spark, "stateful")
    handled = st.stateful_handlers(
        streamed_event_rows(spark, sf_dir), handler, (0, -1),
        output="n bigint, last_batch bigint", state="n bigint, last_batch bigint",
    )
    schema = handled.schema
    st.start_log(spark, f"{folder}/log", schema)
    st.run_epochs(
        handled, lambda rows, epoch: rows, f"{folder}/log", f"{folder}/checkpoint", "update"
    )
    lanes = st.latest(
        st.log_view(spark, f"{folder}/log", schema), ["client_id", "lane"], ["n", "last_batch"]
    )
    return lanes.groupBy("client_id").agg(
        F.sum("n").alias("n"), F.max("last_batch").alias("last_batch")
    )


def _streams(spark, sf_dir):
    games = tenant_games(load_stream(spark, sf_dir, "part"))
    return games, tenant_reviews(load_stream(spark, sf_dir, "lineitem"))


@query("stream_question_platforms", TENANT_PLATFORMS_SQL)
def stream_question_platforms(spark, sf_dir):
    games, _ = _streams(spark, sf_dir)
    return st.stream_platform_counts(games, shared_dir(spark, "platforms"))


@query("stream_question_playtime", TENANT_PLAYTIME_SQL)
def stream_question_playtime(spark, sf_dir):
    games, _ = _streams(spark, sf_dir)
    return st.stream_top_playtime(games, shared_dir(spark, "playtime"), "small", 2010, 10)


@query("stream_question_top", TENANT_TOP_SQL)
def stream_question_top(spark, sf_dir):
    folder = shared_dir(spark, "top-reviewed")
    return st.stream_top_reviewed(*_streams(spark, sf_dir), folder, "small", n=5)


@query("stream_question_over", TENANT_OVER_SQL)
def stream_question_over(spark, sf_dir):
    folder = shared_dir(spark, "over")
    return st.stream_over_threshold(*_streams(spark, sf_dir), folder, "large", 8)


@query("stream_question_percentile", TENANT_PERCENTILE_SQL)
def stream_question_percentile(spark, sf_dir):
    folder = shared_dir(spark, "percentile-question")
    return st.stream_percentile_question(*_streams(spark, sf_dir), folder, "large", 90)


def _arriving(spark, sf_dir, folder, schema):
    """Event rows arrive in a folder, part by part; gives the stream and a function that adds a part."""
    path = f"{folder}/arriving"
    st.start_log(spark, path, None, tenants=True)

    def arrive(condition):
        stored_event_rows(spark, sf_dir).select(*schema.fieldNames()).filter(condition).write.mode(
            "append").parquet(path)

    return spark.readStream.schema(schema).parquet(path), arrive


CONTROL = "action string, client_id bigint"
ARRIVING = T.StructType([
    T.StructField("client_id", T.LongType()),
    T.StructField("app_id", T.LongType()),
    T.StructField("input", T.StringType()),
    T.StructField("batch_id", T.LongType()),
    T.StructField("row_no", T.LongType()),
    T.StructField("eof", T.BooleanType()),
    T.StructField("seq", T.LongType()),
    T.StructField("props", T.StringType()),
])


def _purged_stream(spark, sf_dir, action, client_id):
    """Even batches are worked in, then a tenant is purged, and then the odd batches arrive.

    Gives what each stage holds per tenant at the end: rows of the accepted log, the
    ledger, the newest counts, and the state the counts are kept in.
    """
    folder = shared_dir(spark, "purge")
    rows, arrive = _arriving(spark, sf_dir, folder, ARRIVING)
    st.start_log(spark, f"{folder}/control", None, tenants=True)
    control = spark.readStream.schema(CONTROL).parquet(f"{folder}/control")

    def work():
        st.accept_new_batches(
            rows, f"{folder}/accepted", f"{folder}/ledger", f"{folder}/accept", control=control)
        tagged = rows.select(
            *KEYS, F.col("props").alias("name"), "seq", (F.col("input") == "error").alias("is_review"))
        st.run_purged(
            st.tenant_counts(tagged, lanes=4, control=control), lambda counts, epoch: counts.select(*COUNTS.fieldNames()),
            f"{folder}/counts", f"{folder}/count", mode="update", keys=KEYS)

    arrive("batch_id % 2 = 0")
    work()
    spark.createDataFrame([(action, client_id)], CONTROL).write.mode("append").parquet(f"{folder}/control")
    work()
    arrive("batch_id % 2 = 1")
    work()
    counts = st.latest(st.written_view(spark, f"{folder}/counts", COUNTS), KEYS, ["name", "stat"])
    held = {
        "accepted": st.written_view(spark, f"{folder}/accepted", ARRIVING),
        "ledger": st.written_view(spark, f"{folder}/ledger", LEDGER).select("client_id", "input", "batch_id").distinct(),
        "counts": counts.filter("stat > 0"),
        "state": st.held_games(spark, f"{folder}/count"),
    }
    stages = [
        rows.groupBy("client_id").agg(F.count("*").alias("n")).select(F.lit(stage).alias("stage"), "client_id", "n")
        for stage, rows in held.items()]
    return stages[0].unionByName(stages[1]).unionByName(stages[2]).unionByName(stages[3])


def _purged_sql(left):
    return f"""
WITH {EVENT_ROWS_SQL}, left_over AS (SELECT * FROM event_rows WHERE {left})
SELECT 'accepted' AS stage, client_id, count(*) AS n FROM left_over GROUP BY client_id
UNION ALL
SELECT 'ledger', client_id, count(*) FROM (SELECT DISTINCT client_id, input, batch_id FROM left_over) GROUP BY client_id
UNION ALL
SELECT 'counts', client_id, count(*) FROM (
  SELECT client_id, app_id FROM left_over GROUP BY client_id, app_id
  HAVING count(*) FILTER (input = 'error') > 0
  AND coalesce(arg_max(props, seq) FILTER (input <> 'error'), '') <> '') GROUP BY client_id
UNION ALL
SELECT 'state', client_id, count(DISTINCT app_id) FROM left_over GROUP BY client_id"""


@query("stream_purge_one", _purged_sql("client_id <> 2"))
def stream_purge_one(spark, sf_dir):
    return _purged_stream(spark, sf_dir, "one", 2)


@query("stream_purge_upto", _purged_sql("client_id > 2"))
def stream_purge_upto(spark, sf_dir):
    return _purged_stream(spark, sf_dir, "upto", 2)


@query("stream_late", f"""
WITH {EVENT_ROWS_SQL}
SELECT client_id, app_id, input, batch_id, row_no FROM event_rows WHERE client_id <> 2 OR batch_id % 2 = 0""")
def stream_late(spark, sf_dir):
    """A tenant is finished while the query runs; its rows that arrive later are late."""
    folder = shared_dir(spark, "late")
    rows, arrive = _arriving(spark, sf_dir, folder, ARRIVING)
    query = st.run_open(rows, f"{folder}/done", f"{folder}/log", f"{folder}/checkpoint", every="1 second")
    arrive("batch_id % 2 = 0")
    query.processAllAvailable()
    spark.createDataFrame([(2,)], "client_id bigint").write.parquet(f"{folder}/done/epoch=0")
    arrive("batch_id % 2 = 1")
    query.processAllAvailable()
    query.stop()
    return st.written_view(spark, f"{folder}/log", ARRIVING).select(
        "client_id", "app_id", "input", "batch_id", "row_no")


class Inputs:
    """Rows seen, the rows per input, and the newest rows of a lane: a value, a map and a list."""

    values = {"seen": "n bigint, last_batch bigint"}
    lists = {"newest": "seq bigint"}
    maps = {"inputs": ("input string", "n bigint")}

    def rows(self, key, frames, state):
        n, last = state.seen.get() if state.seen.exists() else (0, -1)
        newest = [row[0] for row in state.newest.get()] if state.newest.exists() else []
        per_input = {}
        for frame in frames:
            n, last = n + len(frame), max(last, int(frame["batch_id"].max()))
            newest = sorted([*newest, *frame["seq"].astype(int)], reverse=True)[:3]
            for name, count in frame["input"].value_counts().items():
                per_input[name] = per_input.get(name, 0) + int(count)
        state.seen.update((n, last))
        state.newest.put([(seq,) for seq in newest])
        for name, count in per_input.items():
            before = state.inputs.getValue((name,)) or (0,)
            state.inputs.updateValue((name,), (before[0] + count,))
        errors = state.inputs.getValue(("error",)) or (0,)
        yield n, last, errors[0], newest


@query("stream_stateful_lanes", f"""
WITH {EVENT_ROWS_SQL}, tenants AS (
  SELECT CASE WHEN client_id = 3 THEN 2 ELSE client_id END AS client_id, input, batch_id, seq FROM event_rows)
SELECT client_id, CAST(ceil(count(*) / 300.0) AS INTEGER) AS lanes, count(*) AS n, max(batch_id) AS last_batch,
       count(*) FILTER (input = 'error') AS errors, array_to_string(list(seq ORDER BY seq DESC)[1:3], ' ') AS newest
FROM tenants GROUP BY client_id""")
def stream_stateful_lanes(spark, sf_dir):
    """A user handler with named states; a tenant has a lane for every 300 rows it is known to have.

    The stream is stopped half way and goes on from its state; one tenant has two thirds of it.
    """
    folder = shared_dir(spark, "lanes")
    two = F.when(F.col("client_id") == 3, 2).otherwise(F.col("client_id")).cast("bigint")
    lanes = stored(st.measured_lanes(
        stored_event_rows(spark, sf_dir).withColumn("client_id", two), per_lane=300), "lanes")
    rows, arrive = _arriving(spark, sf_dir, folder, ARRIVING)
    handled = st.tenant_states(
        rows.withColumn("client_id", two), Inputs(), "n bigint, last_batch bigint, errors bigint, newest array<bigint>",
        values=Inputs.values, lists=Inputs.lists, maps=Inputs.maps, lanes=lanes, lane_key="batch_id",
        columns=["batch_id", "input", "seq"])
    names = ["n", "last_batch", "errors", "newest"]
    schema = T.StructType([field for field in handled.schema if field.name != "purged"])
    st.start_log(spark, f"{folder}/log", schema)
    for part in ("batch_id % 2 = 0", "batch_id % 2 = 1"):
        arrive(part)
        st.run_epochs(handled, lambda rows, epoch: rows.drop("purged"), f"{folder}/log", f"{folder}/checkpoint",
                      "update", keys=["client_id", "lane"])
    newest = F.array_join(F.slice(F.sort_array(F.flatten(F.collect_list("newest")), asc=False), 1, 3), " ")
    log = st.written_view(spark, f"{folder}/log", schema)
    return st.merged(
        log, F.sum("n").alias("n"), F.max("last_batch").alias("last_batch"), F.sum("errors").alias("errors"),
        newest.alias("newest"), values=names).join(lanes, "client_id")


@query("stream_percentile_ranks", TENANT_PERCENTILE_SQL)
def stream_percentile_ranks(spark, sf_dir):
    """The percentile question from ranks that are kept up to date."""
    folder = shared_dir(spark, "percentile-ranks")
    return st.stream_percentile_ranks(*_streams(spark, sf_dir), folder, "large", 90)


READINGS_SQL = f"""
WITH {TENANTS_SQL.replace("FROM lineitem)", ", l_orderkey % 3 AS part FROM lineitem)")}, readings AS (
  SELECT unnest([1, 2, 3]) AS reading), stats AS (
  SELECT reading, CAST(client_id AS BIGINT) AS client_id, app_id, name, count(*) AS stat
  FROM games JOIN reviews USING (client_id, app_id) JOIN readings ON part < reading
  WHERE list_contains(genres, 'large') AND score <> 1
  GROUP BY ALL)
SELECT *, false AS finished FROM stats WHERE stat > 4"""


@query("stream_live_over", f"""{READINGS_SQL}
UNION ALL SELECT 3, CAST(client_id AS BIGINT), NULL, NULL, NULL, true FROM (SELECT DISTINCT client_id FROM reviews)""")
def stream_live_over(spark, sf_dir):
    """Question 4 left running while reviews arrive: two answers on the way, a restart, and the last answer.

    The reviews come in three turns, each of which is a batch of every tenant; the last
    one ends their streams, which adds the finish rows. A turn is written by all tasks that
    read the table, as many files, which the stream may meet apart.
    """
    folder = shared_dir(spark, "live")
    path = f"{folder}/arriving"
    st.start_log(spark, path, None, tenants=True)
    columns = ["l_orderkey", "l_partkey", "l_linenumber", "l_returnflag"]
    lines = load(spark, sf_dir, "lineitem").select(*columns)
    stream = spark.readStream.schema(lines.schema).parquet(path)
    games = tenant_games(load_stream(spark, sf_dir, "part"))
    batch = F.col("l_orderkey") % 3
    numbers = stream.select(
        (F.col("l_linenumber") % 3 + 1).cast("bigint").alias("client_id"), F.lit("reviews").alias("input"),
        batch.alias("batch_id"), (batch == 2).alias("eof"))

    def ask():
        st.start_log(spark, f"{folder}/ledger", LEDGER)
        over = st.stream_over_threshold(games, tenant_reviews(stream), f"{folder}/over", "large", 4, every="1 second")
        ledger = st.run_epochs(numbers, lambda rows, epoch: rows.distinct(), f"{folder}/ledger", f"{folder}/ledger-at",
                               every="1 second", keys=LEDGER.fieldNames())
        return over, st.Running(ledger, lambda: st.completeness(st.written_view(spark, f"{folder}/ledger", LEDGER)))

    readings = []
    for number in (1, 2, 3):
        if number in (1, 3):  # asked, and asked again after a stop
            over, ledger = ask()
        lines.filter(batch == number - 1).write.mode("append").parquet(path)
        complete = ledger.catch_up().answer().filter("complete")
        answer = st.with_finish_rows(over.catch_up().answer(), complete)
        readings.append(stored(answer.select(F.lit(number).alias("reading"), *answer.columns), "reading"))
        if number in (2, 3):
            over.stop()
            ledger.stop()
    return readings[0].unionByName(readings[1]).unionByName(readings[2])
