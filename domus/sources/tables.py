"""Parquet table access and the listings projection of the TPC-H-like tables.

The driver tables carry no listings; ``listings_from_tables`` projects them
onto the wide listing schema (one listing per order).  Everything here is lazy:
column pruning and filters reach the Parquet scans through Catalyst.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from domus.operators.joins import bounded_broadcast

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# region (5 rows) and nation (25 rows) are fixed-size dimensions; the bound is
# still checked before they are broadcast.
GEO_ROW_BOUND = 10_000


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation -> (city, state): nation names are the cities, regions the states."""
    nation = table(spark, sf_dir, "nation", "n_nationkey", "n_name", "n_regionkey")
    region = table(spark, sf_dir, "region", "r_regionkey", "r_name")
    return (nation.join(bounded_broadcast(region, GEO_ROW_BOUND),
                        nation.n_regionkey == region.r_regionkey)
            .select("n_nationkey", F.col("n_name").alias("city"), F.col("r_name").alias("state")))


def order_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order: line count (bed), distinct suppliers (bath), part sizes, quantities.

    Two-level aggregation: (order, supplier) first, then order.  Both levels
    run a map-side partial aggregate, so an order with a huge share of the
    line items is combined before any shuffle.
    """
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
    part = table(spark, sf_dir, "part", "p_partkey", "p_size")
    per_supplier = (li.join(part, li.l_partkey == part.p_partkey)
                    .groupBy("l_orderkey", "l_suppkey")
                    .agg(F.count(F.lit(1)).alias("n_lines"),
                         F.sum("p_size").alias("size_sum"),
                         F.sum("l_quantity").alias("qty_sum")))
    return (per_supplier.groupBy("l_orderkey")
            .agg(F.sum("n_lines").cast("int").alias("bed"),
                 F.count(F.lit(1)).cast("int").alias("bath"),
                 F.sum("size_sum").cast("double").alias("house_size_sqm"),
                 F.sum("qty_sum").alias("lot_size_sqm")))


def listings_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide listing frame (schema ``domus.schema.LISTING``) derived from orders.

    listing_id = order key, broker = customer, status from order status,
    price = order total, city/state = nation/region of the customer,
    zip = 10000 + nation*100 + customer%10, bed/bath/sizes from line items
    (left join: orders without line items keep null details).
    """
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus",
                   "o_totalprice", "o_orderdate")
    customer = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    cust_geo = customer.join(bounded_broadcast(geography(spark, sf_dir), GEO_ROW_BOUND),
                             customer.c_nationkey == F.col("n_nationkey"))
    contents = order_contents(spark, sf_dir)
    joined = (orders.join(cust_geo, orders.o_custkey == cust_geo.c_custkey)
              .join(contents, orders.o_orderkey == contents.l_orderkey, "left"))
    status = (F.when(F.col("o_orderstatus") == "F", F.lit("sold"))
              .when(F.col("o_orderstatus") == "O", F.lit("for_sale"))
              .otherwise(F.lit("ready_to_build")))
    return joined.select(
        F.col("o_orderkey").alias("listing_id"),
        F.col("o_custkey").cast("int").alias("brokered_by"),
        status.alias("status"),
        F.col("o_totalprice").alias("price"),
        F.col("lot_size_sqm"),
        F.col("o_orderkey").cast("double").alias("street"),
        F.col("city"),
        F.col("state"),
        (F.lit(10000) + F.col("c_nationkey") * 100 + F.col("o_custkey") % 10).cast("int").alias("zip_code"),
        F.col("bed"),
        F.col("bath"),
        F.col("house_size_sqm"),
        F.col("o_orderdate").cast("date").alias("prev_sold_date"),
    )
