"""Purges that travel through a stream: state, logs and ledgers of a tenant go.

A control stream has rows (action, client_id), as in ``tenants``. It is dealt into the
data as marks, one per purged tenant, and every stage that holds something clears it
when it meets the mark: a stateful step clears its named state and keeps a flag, a log
deletes the tenant's folders. A purged tenant stays purged: rows that come later, or in
the same micro-batch, are dropped, so the result does not depend on their order.
"""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .epochs import folders, run_epochs, start_log, written_view

MARK = "purged"
MARKS = T.StructType([T.StructField("client_id", T.LongType())])


def purge_marks(control):
    """One row per purged tenant: that of ``one``, or 1 to the id of ``upto``."""
    tenants = F.when(F.col("action") == "one", F.array("client_id")).when(
        (F.col("action") == "upto") & (F.col("client_id") >= 1), F.sequence(F.lit(1).cast("bigint"), "client_id"))
    return control.select(F.explode(tenants).alias("client_id"))


def with_purges(rows, control):
    """Rows and purge marks as one stream; the mark's other columns are null."""
    marks = purge_marks(control).withColumn(MARK, F.lit(True))
    return rows.withColumn(MARK, F.lit(False)).unionByName(marks, allowMissingColumns=True)


def drop_tenants(spark, marks, *logs):
    """Delete the folders of the tenants of ``marks`` from logs that are kept by tenant.

    Only ids that have a folder are asked for, so the driver sees no more of them than
    the listing of the logs has. Other tenants' files are not touched.
    """
    listed, system = {}, None
    for log in logs:
        system, found = folders(spark, f"{log}/epoch=*/client_id=*")
        for folder in found:
            listed.setdefault(int(folder.getName()[len("client_id="):]), []).append(folder)
    if not listed:
        return
    known = spark.createDataFrame([(client_id,) for client_id in listed], MARKS)
    for row in known.join(marks, "client_id", "left_semi").collect():
        for folder in listed[row["client_id"]]:
            system.delete(folder, True)


def run_purged(stream, handle, path, checkpoint, also=(), after=None, **options):
    """``run_epochs`` into a log by tenant, for a stream with marks.

    ``handle`` sees the rows of tenants that no purge has cleared so far. The tenants
    cleared are kept in ``<path>-purged``, one row each; the folders of newly marked ones
    are deleted from the log and from the logs by tenant in ``also``.
    """
    purged = f"{path}-purged"
    spark = stream.sparkSession
    start_log(spark, path, None, tenants=True)
    start_log(spark, purged, MARKS)

    def live(rows, epoch):
        session = rows.sparkSession
        marks = rows.filter(MARK).select(F.col("client_id").cast("bigint").alias("client_id")).distinct()
        marks.write.mode("overwrite").parquet(f"{purged}/epoch={epoch}")
        gone = written_view(session, purged, MARKS, before=epoch + 1).select("client_id").distinct()
        return handle(rows.filter(~F.col(MARK)).drop(MARK).join(gone, "client_id", "left_anti"), epoch)

    def clear(session, epoch):
        if after is not None:
            after(session, epoch)
        drop_tenants(session, session.read.schema(MARKS).parquet(f"{purged}/epoch={epoch}"), path, *also)

    return run_epochs(stream, live, path, checkpoint, after=clear, tenants=True, once=True, **options)
