"""Bulk import of cleaned-CSV lines in one job.

One scan of the input, one shuffle and one partitioned write: valid listings,
rejects (with their text and the reasons) and skipped lines (headers, blanks)
are branches of the same write, ids come from the scan itself, and counts are
observed while it runs.  Every input line ends up in one of the branches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from domus.operators.cleaning import parse_listings_with_reasons, to_wide_listing
from domus.session import materialize
from domus.sources.files import csv_lines, read_lines, with_line_ids, with_line_numbers

VALID, REJECT, SKIPPED = "valid", "reject", "skipped"
PLACE = ("import_no", "kind", "broker_part")  # partition columns
SORT = ("city", "state", "zip_code", "listing_id")
ORIGIN = "src_file string, src_block long, reasons string, line_text string"


def as_lines(data: DataFrame, batch_no: int) -> DataFrame:
    """Text columns of a DataFrame in the form of parsed lines; staged first, as ids
    need an input that is read in the same order again."""
    staged = materialize(data, "import-stage")
    text = F.to_json(F.struct(*[F.col(c) for c in data.columns]))
    return with_line_ids(staged.select("*", F.col("_metadata.file_path").alias("src_file"),
                                       F.col("_metadata.file_block_start").alias("src_block")), batch_no) \
        .select("*", text.alias("line_text"), F.lit(False).alias("skipped"), F.lit(False).alias("malformed"))


def parsed_lines(data: DataFrame | str, batch_no: int, spark: SparkSession, broker_parts: int) -> DataFrame:
    """Wide listing columns with ``kind`` and where each line came from; a reject has its
    text and the reasons (``malformed`` or the mandatory fields that failed)."""
    lines = csv_lines(read_lines(spark, data, batch_no)) if isinstance(data, str) else as_lines(data, batch_no)
    kept = ("skipped", "malformed", "src_file", "src_block", "line_text")
    typed = parse_listings_with_reasons(lines, "listing_id", kept)
    reasons = F.when(F.col("malformed"), F.lit("malformed")).otherwise(F.array_join("reasons", ","))
    kind = F.when(F.col("skipped"), F.lit(SKIPPED)).when(reasons != "", F.lit(REJECT)).otherwise(F.lit(VALID))
    typed = typed.withColumn("kind", kind).withColumn("reasons", F.when(F.col("kind") == REJECT, reasons))
    wide = to_wide_listing(typed, "listing_id", ("kind", "src_file", "src_block", "reasons", "line_text"))
    values = [c for c in wide.columns if c not in ("listing_id", "kind", "src_file", "src_block", "reasons", "line_text")]
    ok = F.col("kind") == VALID
    return wide.select(
        "listing_id", *[F.when(ok, F.col(c)).alias(c) for c in values], "src_file", "src_block", "reasons",
        F.when(F.col("kind") == REJECT, F.col("line_text")).alias("line_text"), F.lit(batch_no).alias("import_no"), "kind",
        F.when(ok, F.pmod("brokered_by", F.lit(broker_parts))).otherwise(F.lit(0)).alias("broker_part"))


def write_import(rows: DataFrame, path: str, max_rows_per_file: int = 0) -> dict[str, int]:
    """Write ``parsed_lines`` as one import, clustered by city inside each broker part;
    an import that is run again replaces what it left.  Returns lines by kind."""
    seen = Observation("import")
    counts = [F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in (VALID, REJECT, SKIPPED)]
    out = rows.observe(seen, *counts).hint("rebalance", *PLACE, "city", "state").sortWithinPartitions(*PLACE, *SORT)
    w = out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    if max_rows_per_file:
        w = w.option("maxRecordsPerFile", max_rows_per_file)
    w.partitionBy(*PLACE).parquet(path)
    return {k: int(v) for k, v in seen.get.items()}


def as_import(listings: DataFrame, batch_no: int, broker_parts: int) -> DataFrame:
    """Typed listings that have ids of their own in the form of ``parsed_lines``."""
    origin = [F.lit(None).cast(kind).alias(name) for name, kind in (c.split() for c in ORIGIN.split(", "))]
    return listings.select("*", *origin, F.lit(batch_no).alias("import_no"), F.lit(VALID).alias("kind"),
                           F.coalesce(F.pmod("brokered_by", F.lit(broker_parts)), F.lit(0)).alias("broker_part"))


def rejects_with_lines(stored: DataFrame, parts: bool = False) -> DataFrame:
    """(src_file, line, reasons, line_text) of the rejects among an import's stored rows;
    ``parts`` as in ``with_line_numbers``."""
    every = stored.select("listing_id", "src_file", "src_block")
    bad = stored.where(F.col("kind") == REJECT).select("listing_id", "src_file", "src_block", "reasons", "line_text")
    return with_line_numbers(bad, every, parts).select("src_file", "line", "reasons", "line_text")

