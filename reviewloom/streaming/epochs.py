"""Exactly-once output of a stream into an epoch log.

Every micro-batch writes one folder ``epoch=<id>`` and overwrites it when it is
run again after a failure, so a restarted query leaves the same table as an
uninterrupted one. Logs and checkpoints belong in a folder all executors share.

A log by tenant has a folder per tenant within each epoch, so a tenant's rows are
deleted without a look at the others' files. A log with ``keys`` starts anew every
``COMPACT_EVERY`` epochs: that epoch holds the newest version of every key, and what
lies before it is no longer read, and deleted one epoch later.
"""

from pyspark.sql import functions as F
from pyspark.sql import types as T

COMPACT_EVERY = 64
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Running:
    """A query that goes on, and the answer so far."""

    def __init__(self, query, view):
        self.query, self._view = query, view

    def answer(self):
        """The rows of the epochs that are written."""
        return self._view()

    def catch_up(self):
        """Wait until all that has arrived by now is worked in."""
        self.query.processAllAvailable()
        return self

    def stop(self):
        self.query.stop()


def answered(query, view):
    """The answer of a query that has ended, or else the running query with its view."""
    return Running(query, view) if query.isActive else view()


def folders(spark, pattern):
    """The folders or files that match a pattern, as Hadoop paths, with their file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    system = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return system, [status.getPath() for status in system.globStatus(path) or []]


def epochs_of(spark, path):
    """The epochs of a log that are written to their end, in order, from its last fresh start on."""
    _, done = folders(spark, f"{path}/epoch=*/_SUCCESS")
    _, starts = folders(spark, f"{path}/_start=*")
    start = max([int(name.getName()[7:]) for name in starts], default=-1)
    found = sorted(int(name.getParent().getName()[6:]) for name in done)
    return [epoch for epoch in found if epoch >= start]


def start_log(spark, path, schema, tenants=False):
    """Create an empty epoch log, unless there is one, so that it can be read."""
    if tenants:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).mkdirs(folder)
        return
    empty = spark.createDataFrame([], schema)
    empty.write.mode("ignore").parquet(f"{path}/epoch=-1")


def log_view(spark, path, schema, before=None, only=None):
    """All rows of an epoch log, those of the epochs before one, or those of one."""
    with_epoch = T.StructType([*schema.fields, T.StructField("epoch", T.LongType())])
    if only is not None:
        one = spark.read.schema(schema).parquet(f"{path}/epoch={only}")
        return one.withColumn("epoch", F.lit(only).cast("bigint"))
    rows = spark.read.schema(with_epoch).parquet(path)
    return rows if before is None else rows.filter(F.col("epoch") < before)


def written_view(spark, path, schema, before=None):
    """The rows of the epochs that are written to their end, while others may be under way.

    Nothing before the last fresh start of the log is read.
    """
    with_epoch = T.StructType([*schema.fields, T.StructField("epoch", T.LongType())])
    chosen = [f"{path}/epoch={e}" for e in epochs_of(spark, path) if before is None or e < before]
    if not chosen:
        return spark.createDataFrame([], with_epoch)
    return spark.read.schema(with_epoch).option("basePath", path).parquet(*chosen)


def newest_view(spark, path, schema, before=None):
    """The rows of the newest epoch of a log that holds a whole answer per epoch."""
    chosen = [e for e in epochs_of(spark, path) if before is None or e < before]
    if not chosen:
        return spark.createDataFrame([], schema)
    return log_view(spark, path, schema, only=chosen[-1]).drop("epoch")


def run_epochs(
    stream, handle, path, checkpoint, mode="append", available_now=True, after=None, first_epoch=0,
    every=None, tenants=False, keys=None, compact_every=COMPACT_EVERY, once=False,
):
    """Run ``handle(rows, epoch) -> DataFrame`` per micro-batch into an epoch log.

    ``after(spark, epoch)`` is called when the epoch's folder is written, within
    the same micro-batch. With ``available_now`` the call processes what is there
    and returns; a later call with the same checkpoint continues. Otherwise, or with a
    processing-time trigger ``every``, the running query is returned. A query with a new
    checkpoint that goes on with a log counts its epochs from ``first_epoch``, which must
    lie above those of the log. ``tenants`` keeps the log by tenant. With ``keys``, the
    log holds versions of these keys and is compacted by itself. ``once``: the rows of a
    micro-batch are written to ``<path>-rows`` first, for a handler that reads them several
    times; a step with state must not run more than once at a time.
    """
    def write(rows, number):
        epoch = first_epoch + number
        if once:
            rows.write.mode("overwrite").parquet(f"{path}-rows")
            rows = rows.sparkSession.read.schema(rows.schema).parquet(f"{path}-rows")
        write_epoch(handle(rows, epoch), path, epoch, tenants, keys, compact_every)
        if after is not None:
            after(rows.sparkSession, epoch)

    writer = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(write)
    )
    if every is not None:
        return _started(stream.sparkSession, writer.trigger(processingTime=every))
    if not available_now:
        return _started(stream.sparkSession, writer)
    query = _started(stream.sparkSession, writer.trigger(availableNow=True))
    query.awaitTermination()
    return query


def write_epoch(rows, path, epoch, tenants=False, keys=None, compact_every=COMPACT_EVERY):
    """Write the folder of an epoch; see ``run_epochs``."""
    spark = rows.sparkSession
    fresh = keys is not None and (epoch + 1) % compact_every == 0
    if fresh:
        old = written_view(spark, path, rows.schema, before=epoch)
        both = old.unionByName(rows.withColumn("epoch", F.lit(epoch).cast("bigint")))
        rows = latest(both, keys, [name for name in rows.columns if name not in keys])
    writer = rows.write.mode("overwrite")
    (writer.partitionBy("client_id") if tenants else writer).parquet(f"{path}/epoch={epoch}")
    if fresh:
        _start_at(spark, path, epoch)


def _started(spark, writer):
    """State goes to RocksDB, which spills to disk and can be read and cleared by key."""
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        return writer.start()
    finally:
        spark.conf.set(STATE_STORE, before)


def _start_at(spark, path, epoch):
    """From now on the log is read from this epoch; what lies before the last start but one goes.

    Readers that began before this start still find their files.
    """
    system, starts = folders(spark, f"{path}/_start=*")
    system.create(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_start={epoch}"), True).close()
    earlier = sorted(int(name.getName()[7:]) for name in starts)
    last = max((start for start in earlier if start < epoch), default=None)
    if last is not None:
        _, found = folders(spark, f"{path}/epoch=*")
        for folder in found:
            if int(folder.getName()[6:]) < last:
                system.delete(folder, True)


def latest(rows, keys, values):
    """The newest version of every key of an update-mode epoch log."""
    newest = F.max(F.struct("epoch", *values)).alias("_newest")
    return rows.groupBy(*keys).agg(newest).select(
        *keys, *[F.col("_newest")[name].alias(name) for name in values]
    )


def compact_log(rows, keys, values, path):
    """Start a new log with only the newest version of every key.

    For logs without ``keys``: stop the query, compact its log to a new folder, and go
    on with that folder and the same checkpoint.
    """
    latest(rows, keys, values).write.parquet(f"{path}/epoch=-1")
