"""File sources: raw and cleaned listing CSVs (all columns as text).

The position of a row in its file is kept for keep-first deduplication as
three columns, ``FILE_ORDER`` = (file path, split start, row id inside the
split); sorting by them is file order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from domus.schema import CLEAN_CSV, RAW_LISTING
from domus.session import materialize


def _with_position(df: DataFrame) -> DataFrame:
    """Add ``src_file`` and ``src_pos`` (ordered within a file, stable across retries).

    ``monotonically_increasing_id`` is (split index << 33) + row in split; a
    file's splits are numbered in file order, so ordering by
    (file, block start, id) is file order.  It is deterministic for the same
    input files and split size, which is what a retried task sees.
    """
    return (df.withColumn("src_file", F.col("_metadata.file_path"))
            .withColumn("src_block", F.col("_metadata.file_block_start"))
            .withColumn("src_pos", F.monotonically_increasing_id())
            .drop("_metadata"))


# Sort order of "first occurrence" for rows read by these readers.
FILE_ORDER = ("src_file", "src_block", "src_pos")


def read_raw_csv(spark: SparkSession, path: str) -> DataFrame:
    """Raw listing export; missing columns stay absent (handled by the cleaner)."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    known = [f.name for f in RAW_LISTING.fields]
    cols = [F.col(c).cast("string") for c in df.columns if c in known]
    return _with_position(df.select(*cols, "_metadata"))


def read_clean_csv(spark: SparkSession, path: str) -> DataFrame:
    """S1 input: cleaned CSV with the fixed text schema."""
    df = spark.read.schema(CLEAN_CSV).option("header", True).csv(path)
    return _with_position(df.select(*CLEAN_CSV.fieldNames(), "_metadata"))


# ---------------------------------------------------------------- every line accounted for
CORRUPT = "_corrupt"
# A line's id: batch number, ordinal of its split, position in the split.
BATCH_SHIFT, SPLIT_SHIFT = 50, 28


def with_line_ids(scan: DataFrame, batch_no: int) -> DataFrame:
    """A scan with ``listing_id`` for each of its rows: unique by construction and the same when a task is
    run again, without a pass that counts.  Holds 2^28 lines a split, 2^22
    splits a batch and 8,191 batches; beyond that it raises."""
    if not 0 < batch_no < 1 << 63 - BATCH_SHIFT:
        raise ValueError(f"batch number must be in 1..{(1 << 63 - BATCH_SHIFT) - 1}")
    at = F.col("_at")  # split << 33 plus position
    split, pos = F.shiftright(at, 33), at.bitwiseAND((1 << 33) - 1)
    fits = (split < 1 << BATCH_SHIFT - SPLIT_SHIFT) & (pos < 1 << SPLIT_SHIFT)
    made = F.lit(batch_no << BATCH_SHIFT).cast("long") + F.shiftleft(split, SPLIT_SHIFT) + pos
    too_many = F.raise_error(F.lit("too many lines for a line id")).cast("long")
    return scan.withColumn("_at", F.monotonically_increasing_id()) \
        .withColumn("listing_id", F.when(fits, made).otherwise(too_many)).drop("_at")


def read_lines(spark: SparkSession, path: str, batch_no: int = 1) -> DataFrame:
    """(listing_id, src_file, src_block, line_text) of every physical line, headers and
    blank lines included.  A quoted line break ends a line here as it does in
    Spark's own line-wise CSV reading."""
    text = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("src_file"), F.col("_metadata.file_block_start").alias("src_block"),
        F.rtrim(F.col("value"), F.lit("\r")).alias("line_text"))
    return with_line_ids(text, batch_no)


def _with_parsed(lines: DataFrame, parsed: Column, fields: list[str], header: Column) -> DataFrame:
    return lines.withColumn("_row", parsed).select(
        *lines.columns, *[F.col(f"_row.{f}").alias(f) for f in fields],
        ((F.trim("line_text") == "") | header).alias("skipped"), F.col(f"_row.{CORRUPT}").isNotNull().alias("malformed"))


def csv_lines(lines: DataFrame, schema: StructType = CLEAN_CSV) -> DataFrame:
    """``lines`` with the text columns of ``schema``, ``skipped`` (header or blank line)
    and ``malformed`` (too few or too many fields, a quote that doesn't end)."""
    names = schema.fieldNames()
    ddl = ", ".join(f"`{f}` string" for f in [*names, CORRUPT])
    parsed = F.from_csv("line_text", ddl, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "escape": "\""})
    return _with_parsed(lines, parsed, names, F.col("line_text") == ",".join(names))


def json_lines(lines: DataFrame, schema: StructType) -> DataFrame:
    """The same for one JSON object a line; what isn't one, or has a value of another
    type, is malformed."""
    row = StructType([*schema.fields, StructField(CORRUPT, StringType())])
    parsed = F.from_json("line_text", row, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    return _with_parsed(lines, parsed, schema.fieldNames(), F.lit(False))


def _in_ranges(splits: DataFrame, ranges: int = 32) -> DataFrame:
    """``splits`` with ``_range``, in the order of names and blocks, and ``_above``, the
    lines of all ranges before: each range tells its total to those after it."""
    dealt = materialize(splits.repartitionByRange(ranges, "src_file", "src_block").withColumn("_range", F.spark_partition_id()),
                        "line-splits")
    after = F.when(F.col("_range") < ranges - 1, F.sequence(F.col("_range") + 1, F.lit(ranges - 1)))
    above = dealt.groupBy("_range").agg(F.sum("_n").alias("_all")).select(F.explode(after).alias("_range"), "_all") \
        .groupBy("_range").agg(F.sum("_all").alias("_above"))
    return dealt.join(above, "_range", "left").withColumn("_above", F.coalesce("_above", F.lit(0)))


def with_line_numbers(rows: DataFrame, every: DataFrame, parts: bool = False) -> DataFrame:
    """``rows`` with ``line``, counted from 1 in their file, or with ``parts`` through
    all files in the order of their names (one text that was written in parts).
    ``every`` holds (listing_id, src_file, src_block) of all lines: its counts by
    split say how many lines the splits before hold."""
    splits = every.groupBy("src_file", "src_block").agg(F.count(F.lit(1)).alias("_n"), F.min("listing_id").alias("_first"))
    key, above = "src_file", F.lit(0)
    if parts:
        splits, key, above = _in_ranges(splits), "_range", F.col("_above")
    before = Window.partitionBy(key).orderBy("src_file", "src_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("src_file", "src_block", "_first", (F.coalesce(F.sum("_n").over(before), F.lit(0)) + above).alias("_off"))
    return rows.join(starts, ["src_file", "src_block"]) \
        .withColumn("line", F.col("_off") + F.col("listing_id") - F.col("_first") + 1).drop("_first", "_off")
