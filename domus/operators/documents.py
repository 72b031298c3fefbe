"""Nested-document layout of listings and the document-style queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domus import params
from domus.operators.usecases import cities_with_min_listings


def to_documents(listings: DataFrame) -> DataFrame:
    """Wide listing -> document: estate_details{}, land_data{}, address{} (city/state lower case)."""
    return listings.select(
        "listing_id", "brokered_by", "status", "price", "prev_sold_date",
        F.struct(F.col("bed"), F.col("bath"), F.col("house_size_sqm").alias("house_size")).alias("estate_details"),
        F.struct(F.col("lot_size_sqm").alias("area_size_in_square_m")).alias("land_data"),
        F.struct(F.col("street"), F.col("zip_code"), F.lower("city").alias("city"),
                 F.lower("state").alias("state")).alias("address"),
    )


def flatten_documents(docs: DataFrame) -> DataFrame:
    """Document -> flat columns (the nested fields promoted to top level)."""
    return docs.select(
        "listing_id", "brokered_by", "status", "price", "prev_sold_date",
        "estate_details.*", "land_data.*", "address.*",
    )


def documents_bedrooms_size(docs: DataFrame, min_bedrooms: int, max_size: float) -> DataFrame:
    """UC6 on documents: predicate on nested fields (pushed to Parquet as nested filters)."""
    n = params.check_min_bedrooms(min_bedrooms)
    m = params.check_max_size(max_size)
    return docs.where((F.col("estate_details.bed") > n) & (F.col("estate_details.house_size") < m))


def lookup_unwind(listings: DataFrame, min_listings: int, max_price: float) -> DataFrame:
    """Qualifying (city, state) groups, each joined to its listings under ``max_price``.

    The document-store pipeline builds an array per group and unwinds it;
    here the lookup is a flat equi-join on (city, state) with the residual
    price predicate, which yields the unwound rows directly and never
    gathers a city's listings into one array.
    """
    mp = params.check_max_price(max_price)
    groups = cities_with_min_listings(listings, min_listings)
    matches = listings.where(F.col("price").isNotNull() & (F.col("price") < mp))
    return groups.join(matches, ["city", "state"]).select(*listings.columns, "n_listings")
