"""Delivery of results while the streams are running."""

from pyspark.sql import functions as F

from ..operators import over_count
from .epochs import answered, latest, run_epochs, start_log, written_view
from .keyed import COUNTS, KEYS


def progress(counts, n, path, checkpoint, **options):
    """Emit every game over the threshold as soon as, and whenever, it changes.

    The epoch log is the progress; the newest version per key is the result so far. It
    is compacted by itself.
    """
    spark = counts.sparkSession
    start_log(spark, path, COUNTS)
    columns = COUNTS.fieldNames()
    query = run_epochs(
        counts,
        lambda rows, epoch: over_count(rows, n).select(*columns),
        path, checkpoint, "update", keys=KEYS, **options,
    )
    return answered(query, lambda: latest(written_view(spark, path, COUNTS), KEYS, ["name", "stat"]))


def with_finish_rows(results, complete):
    """Add one row with ``finished`` set per tenant whose streams are complete."""
    rows = results.withColumn("finished", F.lit(False))
    finish = complete.select("client_id").distinct().withColumn("finished", F.lit(True))
    return rows.unionByName(finish, allowMissingColumns=True)


def first_result(results, arrival, keys=("client_id", "query_no")):
    """The first result per tenant and question; repeats are ignored.

    Rows of equal arrival are told apart by their other columns, in order.
    """
    values = [name for name in results.columns if name not in (*keys, arrival)]
    first = F.min(F.struct(arrival, *values)).alias("_first")
    return results.groupBy(*keys).agg(first).select(*keys, "_first.*")


def run_first_results(
    results, arrival, path, checkpoint, keys=("client_id", "query_no"), **options
):
    """Keep the first result per tenant and question of a stream.

    What an earlier micro-batch delivered stays, whatever arrives later.
    """
    schema = results.schema
    start_log(results.sparkSession, path, schema)

    def handle(rows, epoch):
        delivered = written_view(rows.sparkSession, path, schema, before=epoch).select(*keys)
        first = first_result(rows, arrival, keys)
        return first.join(delivered, list(keys), "left_anti").select(*schema.fieldNames())

    query = run_epochs(results, handle, path, checkpoint, **options)
    return answered(query, lambda: written_view(results.sparkSession, path, schema).drop("epoch"))
