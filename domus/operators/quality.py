"""Data-quality checks standing in for database constraints (enum, NOT NULL,
foreign keys, uniqueness).  Each returns the offending rows or counts as a
DataFrame; none collects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domus.schema import STATUS_VALUES


def check_status(listings: DataFrame, col: str = "status") -> DataFrame:
    """V1: count of rows per status value outside the allowed set (NULL allowed)."""
    bad = listings.where(F.col(col).isNotNull() & ~F.col(col).isin(list(STATUS_VALUES)))
    return bad.groupBy(F.col(col).alias("status")).agg(F.count(F.lit(1)).alias("n_rows"))


def check_not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """V2: NULL count per column, one pass over the data, long format."""
    counts = df.agg(*[F.count(F.when(F.col(c).isNull(), F.lit(1))).alias(c) for c in columns])
    return counts.unpivot([], list(columns), "column_name", "n_null")


def check_orphans(child: DataFrame, parent: DataFrame, keys: Sequence[str]) -> DataFrame:
    """V3: child rows whose key has no parent row (left anti join).

    Child rows with a NULL key are not orphans (a NULL foreign key is allowed).
    """
    present = child
    for k in keys:
        present = present.where(F.col(k).isNotNull())
    return present.join(parent.select(*keys).distinct(), list(keys), "left_anti")


def check_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """V4: key values occurring more than once, with their count."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
            .where(F.col("n_rows") > 1))


def unique_key_report(star: dict[str, DataFrame]) -> DataFrame:
    """V4 for every primary, hash and natural key of the star layout: how many key
    values occur more than once (0 for a sound load)."""
    keys = [("brokers", ["brokered_by"]), ("states", ["state_id"]), ("states", ["state_name"]),
            ("cities", ["city_id"]), ("cities", ["city_name", "state_id"]), ("zip_codes", ["zip_code"]),
            ("listings", ["listing_id"]), ("estate_details", ["listing_id"]), ("land_data", ["listing_id"]),
            ("addresses", ["listing_id"])]
    parts = [check_unique(star[t], k).agg(F.count(F.lit(1)).alias("n_repeated"))
             .select(F.lit(f"{t}({', '.join(k)})").alias("unique_key"), "n_repeated") for t, k in keys]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def foreign_key_report(star: dict[str, DataFrame]) -> DataFrame:
    """Orphan counts for every foreign key of the star layout."""
    rels = [
        ("cities.state_id -> states", star["cities"], star["states"], ["state_id"]),
        ("listings.brokered_by -> brokers", star["listings"], star["brokers"], ["brokered_by"]),
        ("estate_details.listing_id -> listings", star["estate_details"], star["listings"], ["listing_id"]),
        ("land_data.listing_id -> listings", star["land_data"], star["listings"], ["listing_id"]),
        ("addresses.listing_id -> listings", star["addresses"], star["listings"], ["listing_id"]),
        ("addresses.zip_code -> zip_codes", star["addresses"], star["zip_codes"], ["zip_code"]),
        ("addresses.city_id -> cities", star["addresses"], star["cities"], ["city_id"]),
    ]
    parts = [check_orphans(c, p, k).agg(F.count(F.lit(1)).alias("n_orphans"))
             .select(F.lit(name).alias("relation"), "n_orphans") for name, c, p, k in rels]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
