"""Plain partitioned Parquet that changes by whole partitions.

A change reads the partitions it touches, is staged to the shared folder, and
replaces just those (dynamic partition overwrite).  A task that fails or is
run again writes nothing that a reader sees; other partitions aren't rewritten.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from domus.session import materialize, path_exists


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table, or no rows of ``schema`` where nothing was written yet."""
    return spark.read.schema(schema).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], schema)


def touched_partitions(rows: DataFrame, by: Sequence[str]) -> list[tuple]:
    """Values of the partition columns in ``rows``; at most one for each folder."""
    return [tuple(r) for r in rows.select(*by).distinct().collect()]


def only_partitions(table: DataFrame, by: Sequence[str], values: Sequence[tuple]) -> DataFrame:
    """Rows of some partitions: folders are pruned by each column's values, and
    combinations that weren't asked for are left out by a join with the list."""
    out = table
    for i, c in enumerate(by):
        out = out.where(F.col(c).isin(sorted({v[i] for v in values})))
    if len(by) > 1:
        pairs = table.sparkSession.createDataFrame(list(values), table.select(*by).schema)
        out = out.join(F.broadcast(pairs), list(by), "left_semi")  # a row for each folder at most
    return out


def replace_partitions(rows: DataFrame, path: str, by: Sequence[str], sort: Sequence[str] = ()) -> None:
    """Put ``rows`` in the place of the partitions that they hold; the rest stays.

    Rows may come from the table itself: they are staged before any folder changes.
    Each partition is written by few tasks, a large one by several.
    """
    spread = rows.hint("rebalance", *by)
    if sort:
        spread = spread.sortWithinPartitions(*by, *sort)
    staged = materialize(spread, "replace")
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def change_rows(table: DataFrame, path: str, changed: DataFrame, key: str, by: Sequence[str], sort: Sequence[str] = ()) -> int:
    """Replace the rows of ``table`` (read from ``path``) that have the ``key`` of a
    changed row; ``changed`` has the table's columns and lies in the same
    partitions, one row a key.  Returns how many partitions were rewritten."""
    changed = materialize(changed.select(*table.columns), "changed")
    values = touched_partitions(changed, by)
    if values:
        kept = only_partitions(table, by, values).join(changed.select(key), key, "left_anti").select(*table.columns)
        replace_partitions(kept.unionByName(changed), path, by, sort)
    return len(values)
