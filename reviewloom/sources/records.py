"""CSV records with quoted line breaks out of large, splittable files.

Whether a line break ends a record depends on whether it lies in a quoted field,
which depends on all lines before. For each line, two things can be told from the
line alone: whether its end is quoted if its begin is not, and if its begin is.
Such pairs are chained, first over the lines of a block, then over the blocks of
a file, which tells the state at every line. Lines that are whole records go
straight through; only the parts of broken records are put together.

A stray quote inside an unquoted field opens nothing, and the first line that ends
unquoted either way sets the chain right again, so damage stays local.
"""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stored

BLOCK = ["_file", "_block"]

# Possessive, so that long fields need no stack.
QUOTED_TEXT = r'[^"]*+(?:""[^"]*+)*+'
WHOLE_FIELD = f'(?:^|,)"{QUOTED_TEXT}"(?=,|$)'
OPEN_FIELD = f'(?:^|,)"{QUOTED_TEXT}$'
CLOSING = f'^{QUOTED_TEXT}"'


def read_records(spark, path):
    """One row (place, record) per CSV record, without each file's header record.

    Rows in the order of ``place`` are in file order.

    The lines are stored once, with their block and place, so that both passes see the
    same blocks however the file would be cut the next time. A line break that is a bare
    carriage return is an error: read such files with one task per file.
    """
    lines = stored(_lines(spark, path), "csv-lines")
    blocks = stored(_blocks(lines), "csv-blocks")
    ordered = W.partitionBy(*BLOCK).orderBy("_line")
    ends_quoted = F.when(F.col("_begins_quoted"), F.col("_if_quoted")).otherwise(F.col("_if_plain"))
    here = F.struct(F.col("_block").alias("block"), F.col("_line").alias("line"))
    marked = (
        _chained(lines, BLOCK, "_line")
        .join(blocks, BLOCK)
        .withColumn("_ends", ~ends_quoted)
        .withColumn("_starts", F.coalesce(F.lag("_ends").over(ordered), ~F.col("_begins_quoted")))
        .withColumn("_header", (F.col("_block") == 0) & (F.row_number().over(ordered) == 1))
        .withColumn("_start", F.max(F.when(F.col("_starts"), here)).over(
            ordered.rowsBetween(W.unboundedPreceding, 0)
        ))
    )
    is_whole = F.col("_starts") & F.col("_ends")
    whole = marked.filter(is_whole).select(
        "_header", F.struct(F.col("_file").alias("file"), here.alias("at")).alias("place"),
        F.col("value").alias("record"))
    records = whole.unionByName(_joined(marked.filter(~is_whole)))
    return records.filter(~F.col("_header") & (F.col("record") != "")).select("place", "record")


def _blocks(lines):
    """Per block: does it begin quoted, and if so, in which record?

    A file of 100 TB has less than a million blocks. What a block does for either
    state at its begin is worked out per block; only the choice needs their order.
    """
    chained = _chained(lines.drop("value"), BLOCK, "_line")
    ordered = W.partitionBy(*BLOCK).orderBy("_line")
    quoted_before = {
        "_if_plain": F.coalesce(F.lag("_if_plain").over(ordered), F.lit(False)),
        "_if_quoted": F.coalesce(F.lag("_if_quoted").over(ordered), F.lit(True)),
    }
    for state, before in quoted_before.items():
        chained = chained.withColumn(f"_last{state}", F.when(~before, F.col("_line")))
    blocks = chained.groupBy(*BLOCK).agg(
        F.max(F.struct("_line", *quoted_before)).alias("_end"),
        *[F.max(f"_last{state}").alias(f"_last{state}") for state in quoted_before],
    ).select(*BLOCK, "_end.*", *[f"_last{state}" for state in quoted_before])

    in_file = W.partitionBy("_file").orderBy("_block")
    begins = F.coalesce(F.lag("_if_plain").over(in_file), F.lit(False))
    blocks = _chained(blocks, ["_file"], "_block").withColumn("_begins_quoted", begins)
    last = F.when(F.col("_begins_quoted"), F.col("_last_if_quoted")).otherwise(
        F.col("_last_if_plain")
    )
    start = F.when(last.isNotNull(), F.struct(F.col("_block").alias("block"), last.alias("line")))
    earlier = in_file.rowsBetween(W.unboundedPreceding, -1)
    return blocks.select(*BLOCK, "_begins_quoted", F.max(start).over(earlier).alias("_open"))


def _lines(spark, path):
    """Lines with their place and state pair. One task reads a block, in order."""
    line = F.col("value")
    value = F.when(line.endswith("\r"), line.substr(F.lit(1), F.length(line) - 1)).otherwise(line)
    bare = F.raise_error(F.concat(F.lit("bare carriage return in "), F.col("_metadata.file_path"), F.lit(
        ": read it with layout='files'")))
    value = F.when(value.contains("\r"), bare).otherwise(value)
    text = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
        value.alias("value"),
    )
    # Most lines have no quote; they keep the state.
    has_quote = F.col("value").contains('"')
    rest = F.regexp_replace("value", CLOSING, "")
    closes = F.col("value").rlike(CLOSING)
    return text.withColumns({
        "_if_plain": has_quote & _opens(F.col("value")),
        "_if_quoted": ~has_quote | F.when(closes, _opens(rest)).otherwise(True),
    })


def _opens(text):
    """Does a quoted field begin in the text and not end in it?"""
    return F.regexp_replace(text, WHOLE_FIELD, "").rlike(OPEN_FIELD)


def _chained(rows, group, order):
    """Replace the state pair of each row by that of the rows up to it.

    A row whose end does not depend on its begin restarts the chain; any other one
    either keeps the state or turns it.
    """
    so_far = W.partitionBy(*group).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    plain, quoted = F.col("_if_plain"), F.col("_if_quoted")
    turns = rows.withColumn("_turns", F.sum((plain & ~quoted).cast("int")).over(so_far))
    fixed = F.when(plain == quoted, F.struct(order, "_turns", plain.alias("quoted")))
    chained = turns.withColumn("_fixed", F.max(fixed).over(so_far))
    odd = (F.col("_turns") - F.coalesce(F.col("_fixed._turns"), F.lit(0))) % 2 == 1
    restarted = F.col("_fixed.quoted") != odd
    return chained.withColumns({
        "_if_plain": F.coalesce(restarted, odd),
        "_if_quoted": F.coalesce(restarted, ~odd),
    }).drop("_turns", "_fixed")


def _joined(parts):
    """Put the parts of each broken record together, in file order."""
    pieces = F.array_sort(F.collect_list(F.struct("_block", "_line", "value")))
    return parts.groupBy("_file", F.coalesce("_start", "_open").alias("_record")).agg(
        F.bool_or("_header").alias("_header"),
        F.array_join(F.transform(pieces, lambda piece: piece["value"]), "\n").alias("record"),
    ).select("_header", F.struct(F.col("_file").alias("file"), F.col("_record").alias("at")).alias("place"), "record")
