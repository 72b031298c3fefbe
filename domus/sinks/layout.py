"""Layout for filters on any of several columns.

A table sorted by one column lets a reader skip files for filters on that
column alone.  Here rows are ordered along a curve through all the columns:
each value is replaced by its place among 2**bits ranges of about equally
many rows, the bits of the places are interleaved, and files are ranges of
that number.  A file then spans a small range of every column, and its
min/max statistics serve a filter on any of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

INTERLEAVED = ("brokered_by", "zip_code")


def range_edges(df: DataFrame, cols: Sequence[str], bits: int) -> list[list[float]]:
    """Per column, at most 2**bits - 1 ascending values that part the rows into
    ranges of about equally many (one pass, a mergeable sketch a column)."""
    shares = [i / (1 << bits) for i in range(1, 1 << bits)]
    row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), shares, 100 << bits).alias(f"c{i}")
                   for i, c in enumerate(cols)]).first()
    return [sorted({x for x in (row[f"c{i}"] or []) if x == x and abs(x) != float("inf")}) for i in range(len(cols))]


def with_curve_place(df: DataFrame, cols: Sequence[str], bits: int = 8, place_col: str = "_place") -> DataFrame:
    """``df`` with each row's place on the curve through numeric ``cols``.

    Nulls and NaN come after every value.  Only the edges of the ranges, a
    number set by ``bits``, reach the driver.
    """
    cols = list(cols)
    if not 1 <= bits <= 8 or not 1 <= len(cols) <= 6:
        raise ValueError("bits must be in 1..8 and the columns 1 to 6")
    names = [f"_range{i}" for i in range(len(cols))]
    splits = [[float("-inf"), *(edges or [0.0]), float("inf")] for edges in range_edges(df, cols, bits)]
    inputs = [f"_in{i}" for i in range(len(cols))]
    ranged = Bucketizer(splitsArray=splits, inputCols=inputs, outputCols=names, handleInvalid="keep") \
        .transform(df.select("*", *[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(i)
                                    for c, i in zip(cols, inputs)]))
    place = F.lit(0).cast("long")
    for b in range(bits + 1):  # one more bit for the range of nulls
        for i, c in enumerate(names):
            bit = F.shiftright(F.col(c).cast("long"), b).bitwiseAND(F.lit(1).cast("long"))
            place = place + F.shiftleft(bit, b * len(cols) + i)
    return ranged.withColumn(place_col, place).drop(*names, *inputs)


def write_interleaved(df: DataFrame, path: str, cols: Sequence[str] = INTERLEAVED, files: int | None = None,
                      bits: int = 8, id_col: str = "listing_id", mode: str = "errorifexists") -> int:
    """Write ``df`` in ``files`` files of about equal size along the curve; returns the
    rows written, counted by the write itself.

    ``id_col`` breaks ties, so rows with one common pair of values spread over
    as many files as they fill.  The input is read three times: for the edges
    of the ranges, for the sample of the range partitioner, and to write.
    """
    files = files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["_place", *cols, id_col]
    seen = Observation("interleaved")
    with_curve_place(df, cols, bits).repartitionByRange(files, *order).sortWithinPartitions(*order).drop("_place") \
        .observe(seen, F.count(F.lit(1)).alias("rows")).write.mode(mode).parquet(path)
    return int(seen.get["rows"])
