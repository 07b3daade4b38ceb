"""Result and copy sinks. Every one writes in parallel, one file per task."""

from ..functions import bucket_of
from ..schema import RESULT_HEADERS


def as_result(df, number):
    """Rename the columns of a question's answer to its fixed result header."""
    return df.toDF(*RESULT_HEADERS[number])


def write_result(df, path, number, fmt="csv"):
    """Write the answer of one question to ``path/<number>``."""
    write_copy(df, f"{path}/{number}", fmt)


def write_copy(df, path, fmt="csv"):
    """Write whole rows, with a header line in every CSV part."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.options(
            header=True, quote='"', escape='"',
            ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
        )
    writer.format(fmt).save(path)


def write_buckets(df, path, key, buckets, fmt="parquet"):
    """Write one folder ``bucket=<1..n>`` per remainder class of the key."""
    (
        df.withColumn("bucket", bucket_of(key, buckets))
        .write.mode("overwrite")
        .partitionBy("bucket")
        .format(fmt)
        .save(path)
    )


def save_bucketed(df, table, key, buckets):
    """Save a table partitioned and sorted by key, for repeated keyed joins.

    Tables saved with the same number of buckets are joined without a shuffle.
    """
    (
        df.repartition(buckets, key)
        .write.mode("overwrite")
        .bucketBy(buckets, key)
        .sortBy(key)
        .saveAsTable(table)
    )
