"""Collision-free row ids for appended data.

id = (batch number << 40) + dense position of the row inside the batch.

The dense position comes from the input's own partitioning: every row gets
its partition id and a monotonically increasing id; rows are counted per
partition (one row per input partition), offsets are running sums over those
counts, and position = offset of the partition + index inside it.  Ids are
unique by construction (up to 2^40 rows per batch, 2^23 batches) instead of
by the odds of a hash, and a retried task computes the same ids: the input
must be re-readable in the same order (files, or a staged copy).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from domus.session import materialize

LOW_BITS = 40
MAX_BATCH = (1 << (63 - LOW_BITS)) - 1


def with_batch_ids(df: DataFrame, batch_no: int, id_col: str = "listing_id", order: Sequence[str] = ()) -> DataFrame:
    """``order``: columns that name the split a row was read from, such as file and start;
    positions then follow them, not the partitions that the splits were dealt to."""
    if not 0 <= batch_no <= MAX_BATCH:
        raise ValueError(f"batch number must be in 0..{MAX_BATCH}")
    rows = (df.withColumn("_pid", F.spark_partition_id())
            .withColumn("_mid", F.monotonically_increasing_id()))
    part = list(order) or ["_pid"]
    counts = rows.groupBy(*part).agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    # one row per input partition or split: this window's single task sees at
    # most that many rows
    before = Window.orderBy(*part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*part, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    # broadcast bound: one row per input partition or split of ``df``
    joined = rows.join(F.broadcast(offsets), part)
    new_id = F.lit(batch_no << LOW_BITS).cast("long") + F.col("_off") + F.col("_mid") - F.col("_first")
    return joined.withColumn(id_col, new_id).drop("_pid", "_mid", "_off", "_first")


def with_next_ids(df: DataFrame, order: Sequence[str], id_col: str, start: int) -> DataFrame:
    """``df`` with dense ids from ``start`` by ascending ``order``.

    The rows are range-partitioned, so none but the counts of the partitions
    meet in one task.  They are staged with their places first, because a
    range partitioner may cut a second evaluation elsewhere.
    """
    placed = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order)
                         .withColumn("_pid", F.spark_partition_id())
                         .withColumn("_mid", F.monotonically_increasing_id()), "next-ids")
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    firsts = placed.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first")) \
        .select("_pid", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return placed.join(F.broadcast(firsts), "_pid") \
        .withColumn(id_col, F.lit(start).cast("long") + F.col("_off") + F.col("_mid") - F.col("_first")) \
        .drop("_pid", "_mid", "_first", "_off")
