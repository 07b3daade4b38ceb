"""Batch numbers: duplicates, gaps and senders.

Rows carry the tenant (``client_id``), the input they came by (``input``) and the
number of their batch (``batch_id``, from 0 per tenant and input). The last batch
has ``eof`` set on its rows.
"""

from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .epochs import log_view, run_epochs, start_log, write_epoch, written_view
from .purges import run_purged, with_purges

BATCH_KEYS = ["client_id", "input", "batch_id"]
BLOCK = 4096

LEDGER = T.StructType([
    T.StructField("client_id", T.LongType()),
    T.StructField("input", T.StringType()),
    T.StructField("batch_id", T.LongType()),
    T.StructField("eof", T.BooleanType()),
])


def first_delivery(rows, arrival, keys=BATCH_KEYS):
    """Rows of the first delivery of every batch; repeats are ignored.

    ``arrival`` identifies a delivery and orders them. Only the batch keys are
    aggregated. The list of repeated deliveries is what is joined back, so a
    stream with few repeats never shuffles its rows.
    """
    deliveries = rows.groupBy(*keys, arrival).agg(F.count(F.lit(1)).alias("_rows"))
    repeated = deliveries.groupBy(*keys).agg(
        F.min(arrival).alias("_first"), F.count(F.lit(1)).alias("_times")
    ).filter(F.col("_times") > 1)
    surplus = deliveries.join(repeated, list(keys)).filter(F.col(arrival) > F.col("_first"))
    return rows.join(surplus.select(*keys, arrival), [*keys, arrival], "left_anti")


def once(rows, row_no="row_no", keys=BATCH_KEYS):
    """Each row of a batch once, where copies of a batch cannot be told apart.

    Batches that come more than once are looked for by batch and row number; only their
    rows are shuffled whole.
    """
    numbered = rows.groupBy(*keys, row_no).agg(F.count(F.lit(1)).alias("_copies"))
    repeated = numbered.filter(F.col("_copies") > 1).select(*keys).distinct()
    single = rows.join(repeated, list(keys), "left_anti")
    several = rows.join(repeated, list(keys), "left_semi").dropDuplicates([*keys, row_no])
    return single.unionByName(several)


def accept_new_batches(stream, path, ledger, checkpoint, row_no="row_no", control=None, **options):
    """Append each row of each batch of a stream once, and keep a ledger of batch numbers.

    A batch may arrive in parts over several micro-batches. Rows of batches that no
    earlier epoch knows, which the ledger with its one row per batch tells, only lose
    the repeats inside the micro-batch, by ``once``. For known batches the rows that were
    accepted before are dropped by row number; the log is read for those only within the
    number range of the micro-batch. The micro-batch is kept while it is worked on. The
    ledger is compacted by itself.

    With a ``control`` stream of purges (see ``purges``) the log and the ledger are kept by
    tenant, and lose the tenants that it purges.
    """
    schema = stream.schema
    tenants = control is not None
    start_log(stream.sparkSession, path, schema, tenants)
    start_log(stream.sparkSession, ledger, LEDGER, tenants)

    kept = {}

    def handle(rows, epoch):
        while kept:  # left by an attempt that failed
            kept.popitem()[1].unpersist()
        kept[epoch] = rows = rows.persist()
        seen = written_view(rows.sparkSession, ledger, LEDGER, before=epoch)
        accepted = written_view(rows.sparkSession, path, schema, before=epoch)
        span = rows.agg(F.min("batch_id"), F.max("batch_id")).first()
        if span[0] is not None:
            seen, accepted = (x.filter(F.col("batch_id").between(*span)) for x in (seen, accepted))
        new = rows.join(seen.select(*BATCH_KEYS).distinct(), BATCH_KEYS, "left_anti")
        known = rows.join(seen.select(*BATCH_KEYS).distinct(), BATCH_KEYS, "left_semi")
        late = known.join(accepted.select(*BATCH_KEYS, row_no), [*BATCH_KEYS, row_no], "left_anti")
        return once(new, row_no).unionByName(late.dropDuplicates([*BATCH_KEYS, row_no]))

    def note(spark, epoch):
        kept.pop(epoch).unpersist()
        accepted = log_view(spark, path, schema, only=epoch)
        numbers = accepted.groupBy(*BATCH_KEYS).agg(F.bool_or("eof").alias("eof"))
        write_epoch(numbers, ledger, epoch, tenants, keys=LEDGER.fieldNames())

    if not tenants:
        return run_epochs(stream, handle, path, checkpoint, after=note, **options)
    return run_purged(with_purges(stream, control), handle, path, checkpoint, also=[ledger], after=note, **options)


def completeness(rows, by=("client_id", "input")):
    """Per tenant and input: is the end seen and no lower number missing?"""
    numbers = rows.groupBy(*by, "batch_id").agg(F.bool_or("eof").alias("eof"))
    state = numbers.groupBy(*by).agg(
        F.max("batch_id").alias("last_batch"),
        F.count(F.lit(1)).alias("batches"),
        F.bool_or("eof").alias("eof"),
    )
    complete = F.col("eof") & (F.col("batches") == F.col("last_batch") + 1)
    return state.withColumn("complete", complete)


def missing_ranges(rows, by=("client_id", "input")):
    """Ranges (first_missing, last_missing) of numbers below the largest one that no row carries.

    Numbers meet their neighbours in blocks, and blocks theirs, so a long stream is no
    single window, and a range costs the same whatever its length.
    """
    by = list(by)
    numbers = rows.select(*by, "batch_id").distinct().withColumn(
        "_block", F.floor(F.col("batch_id") / BLOCK).cast("bigint"))
    following = F.lead("batch_id").over(W.partitionBy(*by, "_block").orderBy("batch_id"))
    inside = numbers.select(*by, F.col("batch_id").alias("_before"), following.alias("_after"))
    blocks = numbers.groupBy(*by, "_block").agg(
        F.min("batch_id").alias("_after"), F.max("batch_id").alias("_last"))
    earlier = F.lag("_last").over(W.partitionBy(*by).orderBy("_block"))
    between = blocks.select(*by, F.coalesce(earlier, F.lit(-1)).cast("bigint").alias("_before"), "_after")
    return inside.unionByName(between).filter(F.col("_after") > F.col("_before") + 1).select(
        *by, (F.col("_before") + 1).alias("first_missing"), (F.col("_after") - 1).alias("last_missing"))


def missing_batches(rows, by=("client_id", "input")):
    """The numbers of ``missing_ranges`` one by one; for gaps that are not too long to list."""
    return missing_ranges(rows, by).select(
        *by, F.explode(F.sequence("first_missing", "last_missing")).alias("batch_id"))


def senders_complete(reports, senders, by=("client_id",), sender="sender"):
    """Per tenant: have all expected senders reported? Repeats do not count."""
    once = reports.groupBy(*by, sender).agg(F.lit(1).alias("_one"))
    return once.groupBy(*by).agg(F.count(F.lit(1)).alias("reported")).withColumn(
        "complete", F.col("reported") == senders
    )
