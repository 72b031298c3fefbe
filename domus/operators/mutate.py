"""Bulk changes as pure transforms (DataFrame -> DataFrame).

Parquet files are immutable: a change yields a new frame that is written to
a new place (staged, then whole partitions are replaced by
``sinks.partitioned``); what is being read is never overwritten before it is staged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domus.operators.joins import first_per_group


def add_column_if_missing(df: DataFrame, name: str, dtype: str) -> DataFrame:
    """``ADD COLUMN IF NOT EXISTS name dtype DEFAULT NULL``."""
    return df if name in df.columns else df.withColumn(name, F.lit(None).cast(dtype))


def drop_column_if_exists(df: DataFrame, name: str) -> DataFrame:
    return df.drop(name) if name in df.columns else df


def one_per_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key, the same one on every run (partial aggregate, skew-safe)."""
    return first_per_group(df, list(keys), [])


def insert_if_absent(target: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``INSERT ... ON CONFLICT DO NOTHING``: incoming rows whose key is new, appended.

    Incoming key duplicates collapse to one row (as the conflict rule would
    reject the second), chosen deterministically (smallest row); the anti
    join shuffles both sides by the key once.
    """
    new_rows = one_per_key(incoming, keys).join(target.select(*keys), list(keys), "left_anti")
    return target.unionByName(new_rows.select(*target.columns))


def upsert(target: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``INSERT ... ON CONFLICT DO UPDATE SET col = EXCLUDED.col``: incoming rows win."""
    incoming = one_per_key(incoming, keys).select(*target.columns)
    kept = target.join(incoming.select(*keys), list(keys), "left_anti")
    return kept.unionByName(incoming)


def new_keys_count(target: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number of rows an insert-if-absent adds (the import's returned count)."""
    return (incoming.select(*keys).distinct().join(target.select(*keys), list(keys), "left_anti")
            .agg(F.count(F.lit(1)).alias("n_new")))
