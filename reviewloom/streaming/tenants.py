"""Tenants that are finished or purged.

A purge control table has rows (action, client_id): ``one`` clears that tenant,
``upto`` clears the tenants 1..client_id. A purged tenant stays purged.
"""

from pyspark.sql import functions as F

from ..operators import without_listed
from .epochs import run_epochs, start_log, written_view
from .purges import MARKS


def drop_done(rows, done):
    """Drop late rows of tenants that are already finished."""
    return without_listed(rows, done, "client_id")


def run_open(stream, done, path, checkpoint, **options):
    """Append the rows of tenants that are not finished when their micro-batch is worked in.

    ``done`` is an epoch log of the ids of finished tenants. It may grow while the query
    runs: each micro-batch reads it as it is by then.
    """
    spark = stream.sparkSession
    start_log(spark, path, stream.schema)
    start_log(spark, done, MARKS)

    def handle(rows, epoch):
        return drop_done(rows, written_view(rows.sparkSession, done, MARKS).select("client_id").distinct())

    return run_epochs(stream, handle, path, checkpoint, **options)


def purged_ids(ids, control):
    """Those of the given tenant ids that a purge clears."""
    one = control.filter(F.col("action") == "one").select("client_id").distinct()
    ceiling = control.filter(F.col("action") == "upto").agg(
        F.coalesce(F.max("client_id"), F.lit(0)).alias("ceiling")
    ).scalar()
    upto = ids.select("client_id").filter(F.col("client_id").between(F.lit(1), ceiling))
    return upto.unionByName(ids.select("client_id").join(one, "client_id", "left_semi")).distinct()


def live_rows(rows, control):
    """Rows of the tenants that no purge clears."""
    one = control.filter(F.col("action") == "one").select("client_id").distinct()
    ceiling = control.filter(F.col("action") == "upto").agg(
        F.coalesce(F.max("client_id"), F.lit(0)).alias("ceiling")
    ).scalar()
    kept = rows.filter(~F.col("client_id").between(F.lit(1), ceiling))
    return without_listed(kept, one, "client_id")


def rewrite_without(rows, control, path):
    """Write a table again, by tenant, without the purged ones."""
    (
        live_rows(rows, control)
        .write.mode("overwrite")
        .partitionBy("client_id")
        .parquet(path)
    )
