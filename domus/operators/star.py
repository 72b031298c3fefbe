"""Normalized star layout: brokers, states, cities, zip codes, listings and
their detail tables, and the join back to the 13-column listing detail.

Surrogate keys of the dimensions are deterministic hashes of their natural
keys (``hash_id``), so a fact row computes its dimension keys locally: no
dimension lookup join and no global numbering window on the load path.  The
listing id is assigned once in staging and carried to every child table, so
children never need to be matched back on natural keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domus.functions.text import hash_id


def star_brokers(listings: DataFrame) -> DataFrame:
    return listings.select("brokered_by").where(F.col("brokered_by").isNotNull()).distinct()


def star_states(listings: DataFrame) -> DataFrame:
    return (listings.select(F.col("state").alias("state_name"))
            .where(F.col("state_name").isNotNull()).distinct()
            .select(hash_id("state_name").alias("state_id"), "state_name"))


def star_cities(listings: DataFrame) -> DataFrame:
    pairs = (listings.select(F.col("city").alias("city_name"), F.col("state").alias("state_name"))
             .where(F.col("city_name").isNotNull() & F.col("state_name").isNotNull()).distinct())
    state_id = hash_id("state_name")
    return pairs.select(hash_id("city_name", state_id).alias("city_id"), "city_name",
                        state_id.alias("state_id"))


def star_zip_codes(listings: DataFrame) -> DataFrame:
    return listings.select("zip_code").where(F.col("zip_code").isNotNull()).distinct()


def star_listings(listings: DataFrame) -> DataFrame:
    return listings.select("listing_id", "brokered_by", "status", "price",
                           F.col("prev_sold_date").cast("date").alias("prev_sold_date"))


def star_estate_details(listings: DataFrame) -> DataFrame:
    any_detail = F.col("bed").isNotNull() | F.col("bath").isNotNull() | F.col("house_size_sqm").isNotNull()
    return listings.where(any_detail).select("listing_id", "bed", "bath",
                                             F.col("house_size_sqm").alias("house_size"))


def star_land_data(listings: DataFrame) -> DataFrame:
    return listings.where(F.col("lot_size_sqm").isNotNull()) \
        .select("listing_id", F.col("lot_size_sqm").alias("area_size_in_square_m"))


def star_addresses(listings: DataFrame) -> DataFrame:
    complete = (F.col("street").isNotNull() & F.col("zip_code").isNotNull()
                & F.col("city").isNotNull() & F.col("state").isNotNull())
    return listings.where(complete).select(
        "listing_id", "street", "zip_code", hash_id("city", hash_id("state")).alias("city_id"))


def resolve_city_ids(listings: DataFrame, cities: DataFrame, states: DataFrame) -> DataFrame:
    """Natural (city, state) -> city_id by lookup in existing dimension tables.

    The relational import resolves the state id with a correlated scalar
    subquery per row; here it is two equi-joins (states, then cities on
    (city_name, state_id)).  Both dimensions are small and are broadcast by
    AQE from their measured size; rows whose city is unknown get NULL.
    """
    with_state = listings.join(states.select(F.col("state_name").alias("state"), "state_id"), "state", "left")
    return with_state.join(cities.select(F.col("city_name").alias("city"), "state_id", "city_id"),
                           ["city", "state_id"], "left").drop("state_id")


def star_tables(listings: DataFrame) -> dict[str, DataFrame]:
    """All eight tables from one staging frame (write the staging once first)."""
    return {
        "brokers": star_brokers(listings),
        "states": star_states(listings),
        "cities": star_cities(listings),
        "zip_codes": star_zip_codes(listings),
        "listings": star_listings(listings),
        "estate_details": star_estate_details(listings),
        "land_data": star_land_data(listings),
        "addresses": star_addresses(listings),
    }


def listing_details(star: dict[str, DataFrame]) -> DataFrame:
    """The 13-column listing detail over the star (inner chain + two left joins).

    listings, addresses, estate_details and land_data all join on
    ``listing_id``: Spark shuffles each side once by that key and chains the
    joins without re-shuffling; cities and states are small dimensions that
    AQE broadcasts from measured sizes.
    """
    l, a = star["listings"], star["addresses"]
    ci, s = star["cities"], star["states"]
    ed, ld = star["estate_details"], star["land_data"]
    joined = (l.join(a, "listing_id")
              .join(ci, "city_id")
              .join(s, "state_id")
              .join(ed, "listing_id", "left")
              .join(ld, "listing_id", "left"))
    return joined.select(
        "listing_id", "brokered_by", F.col("status").cast("string").alias("status"), "price",
        "prev_sold_date", "bed", "bath", F.col("house_size").alias("house_size_sqm"),
        F.col("area_size_in_square_m").alias("lot_size_sqm"), "street", "zip_code",
        F.col("city_name").alias("city"), F.col("state_name").alias("state"),
    )


def star_to_wide(star: dict[str, DataFrame]) -> DataFrame:
    """Round trip back to the wide listing column order."""
    d = listing_details(star)
    return d.select("listing_id", "brokered_by", "status", "price", "lot_size_sqm", "street", "city",
                    "state", "zip_code", "bed", "bath", "house_size_sqm", "prev_sold_date")

