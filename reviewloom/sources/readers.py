"""CSV sources for the catalogue and its reviews, bound by position.

The readers return untouched text fields plus ``n_fields``, the number of fields
the record had; ``cleaning`` turns them into typed rows.

Records may hold quoted line breaks, so Spark cannot cut a file anywhere. The
``layout`` says how to read in parallel:

* ``files``   one task per file; the default, for exports of many files
* ``blocks``  files of any size, cut into blocks whose records are put together
* ``lines``   files of any size without quoted line breaks
"""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import field_count
from ..schema import GAME_FIELDS, GAME_WIDTH, REVIEW_FIELDS, REVIEW_WIDTH
from .records import read_records

RAW_RECORD = "_raw_record"
CSV_OPTIONS = {
    "quote": '"',
    "escape": '"',
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": RAW_RECORD,
}


def read_games(spark, path, width=None, layout="files", original=False, place=False):
    """See the module; ``original`` and ``place`` as in ``read_reviews``."""
    return _read(spark, path, GAME_FIELDS, GAME_WIDTH, width, layout, original, place)


def read_reviews(spark, path, width=None, layout="files", original=False, place=False):
    """Text fields, and on demand what a whole copy or a sample in file order needs.

    ``original`` adds a struct of all fields of the record, named by the header;
    ``write_copy(rows.select("original.*"), path)`` writes the whole records again.
    ``place`` adds a sortable struct: rows in its order are in file order.
    """
    return _read(spark, path, REVIEW_FIELDS, REVIEW_WIDTH, width, layout, original, place)


def stream_games(spark, path, width=GAME_WIDTH, layout="files", **options):
    return _stream(spark, path, GAME_FIELDS, width, layout, options)


def stream_reviews(spark, path, width=REVIEW_WIDTH, layout="files", **options):
    return _stream(spark, path, REVIEW_FIELDS, width, layout, options)


def spread(table, key):
    """Use all cores on a table stored in few pieces, before costly work per row.

    A table that is already read by enough tasks, which any large one is, comes
    back as it is. For tables as read: asking a frame that holds joins or
    aggregations for its tasks would run them.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table if table.rdd.getNumPartitions() >= cores else table.repartition(cores, key)


def _read(spark, path, fields, least, width, layout, original, place):
    header = _header(spark, path) if original or not width else []
    width = width or max(least, len(header))
    if layout == "blocks":
        parsed = F.from_csv("record", _schema(width).simpleString(), CSV_OPTIONS)
        # A generator, so that a record is parsed once and not once per use of a field.
        raw = read_records(spark, path).select("place", F.inline(F.array(parsed)))
    else:
        raw = _reader(spark.read, width, layout).csv(path)
        if place:
            raw = raw.select("*", F.struct(
                F.col("_metadata.file_path").alias("file"),
                F.col("_metadata.file_block_start").alias("block"),
                F.monotonically_increasing_id().alias("line"),
            ).alias("place"))
    more = [F.col("place")] if place else []
    if original:
        names = [*header, *[f"_f{i}" for i in range(len(header), width)]]
        more.append(F.struct(*[F.col(f"_f{i}").alias(names[i]) for i in range(width)]).alias("original"))
    return _fields(raw, fields, width, *more)


def _stream(spark, path, fields, width, layout, options):
    raw = _reader(spark.readStream, width, layout).options(**options).csv(path)
    return _fields(raw, fields, width)


def _reader(reader, width, layout):
    if layout not in ("files", "lines"):
        raise ValueError(f"unknown layout: {layout}")
    return reader.schema(_schema(width)).options(
        header=True, enforceSchema=True, multiLine=layout == "files", **CSV_OPTIONS
    )


def _schema(width):
    names = [f"_f{i}" for i in range(width)] + [RAW_RECORD]
    return T.StructType([T.StructField(name, T.StringType()) for name in names])


def _header(spark, path):
    """Names in the header line; their number tells which records are ragged."""
    return spark.read.options(header=True, quote='"', escape='"').csv(path).columns


def _fields(raw, fields, width, *more):
    n_fields = F.when(F.col(RAW_RECORD).isNull(), F.lit(width)).otherwise(field_count(RAW_RECORD))
    return raw.select(
        *[F.col(f"_f{position}").alias(name) for name, position in fields.items()],
        n_fields.alias("n_fields"),
        *more,
    )
