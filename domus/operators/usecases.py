"""The listing use cases as lazy DataFrame transforms over a wide listing frame.

Every function takes a listing ``DataFrame`` (schema ``domus.schema.LISTING``,
possibly with extra columns) and returns a ``DataFrame``; nothing is
collected.  Parameter checks run on the driver before any plan is built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domus import params
from domus.functions.measures import adjust_price, city_key, norm_text, price_per_sqm, random_flag
from domus.schema import (
    DEFAULT_BELOW_AVG_PCT, DEFAULT_BROKER_ID, DEFAULT_CITY, DEFAULT_LIMIT, DEFAULT_MAX_PRICE,
    DEFAULT_MAX_SIZE_SQM, DEFAULT_MIN_BEDROOMS, DEFAULT_MIN_LISTINGS, DEFAULT_PERCENT_DELTA,
    DEFAULT_POSTAL_CODE,
)


# Largest id set (rows) a price update broadcasts; a parameter bound, not data-dependent.
BROADCAST_ID_LIMIT = 1_000_000


# ---------------------------------------------------------------- aggregates
def cities_with_min_listings(listings: DataFrame, min_listings: int = DEFAULT_MIN_LISTINGS) -> DataFrame:
    """(city, state, n_listings) for groups with more than ``min_listings`` rows.

    Partial (map-side) count then final count: hot cities are combined before
    the shuffle.  Only the two key columns are read from the scan.
    """
    n = params.check_min_listings(min_listings)
    return (listings.select("city", "state")
            .where(F.col("city").isNotNull() & F.col("state").isNotNull())
            .groupBy("city", "state")
            .agg(F.count(F.lit(1)).alias("n_listings"))
            .where(F.col("n_listings") > n))


def eligible_for_ratio(listings: DataFrame, require_positive_price: bool = True) -> DataFrame:
    """Rows usable for price per m2: lot > 0 and price > 0 (or not null)."""
    cond = F.col("lot_size_sqm").isNotNull() & (F.col("lot_size_sqm") > 0) & F.col("price").isNotNull()
    if require_positive_price:
        cond = cond & (F.col("price") > 0)
    return listings.where(cond)


def avg_if(listings: DataFrame, keys=("city", "state"), min_price: float = 0.0) -> DataFrame:
    """Conditional average: avg(price/lot) over rows with lot > 0 and price > min_price.

    Every group of the input is kept; a group without a qualifying row gets
    NULL (the aggregate FILTER semantics), unlike UC5 which drops it.
    """
    ok = (F.col("lot_size_sqm") > 0) & (F.col("price") > min_price)
    return (listings.groupBy(*keys)
            .agg(F.avg(F.when(ok, price_per_sqm())).alias("avg_price_per_sqm"),
                 F.count(F.when(ok, F.lit(1))).alias("n_eligible")))


# ---------------------------------------------------------------- existence checks
def _require_any(listings: DataFrame, cond, what: str) -> None:
    """Opt-in check (``validate=True``): raise if no row matches (a bounded probe job)."""
    if listings.where(cond).limit(1).count() == 0:
        raise ValueError(f"{what} not found")


# ---------------------------------------------------------------- use cases
def uc1_filter_properties(listings: DataFrame, min_listings: int = DEFAULT_MIN_LISTINGS,
                          max_price: float = DEFAULT_MAX_PRICE) -> DataFrame:
    """Listings under ``max_price`` in cities with more than ``min_listings`` listings.

    The count covers all listings of a city (the price cap is not part of
    it).  The qualifying set joins back as a left-semi join; its size is only
    known at runtime, so AQE picks broadcast vs. shuffle from measured bytes
    and splits skewed partitions if it stays a sort-merge join.
    """
    max_price = params.check_max_price(max_price)
    qualifying = cities_with_min_listings(listings, min_listings).select("city", "state")
    return (listings.where(F.col("price") < max_price)
            .join(qualifying, ["city", "state"], "left_semi")
            .select(*listings.columns)
            .orderBy("city", "state", "price", "listing_id"))


def first_listings_of_broker(listings: DataFrame, broker: int, limit: int,
                             skip_null_price: bool = False) -> DataFrame:
    """The first ``limit`` listing ids of one broker (ascending id): a top-k."""
    cond = F.col("brokered_by") == broker
    if skip_null_price:
        cond = cond & F.col("price").isNotNull()
    return listings.where(cond).select("listing_id").orderBy("listing_id").limit(limit)


def uc2_update_prices(listings: DataFrame, broker_id: str = DEFAULT_BROKER_ID,
                      percent_delta: float = DEFAULT_PERCENT_DELTA, limit: int = DEFAULT_LIMIT,
                      skip_null_price: bool = False, validate: bool = False) -> DataFrame:
    """Copy-on-write price change for the first ``limit`` listings of a broker.

    Returns the whole table with new prices and an ``updated`` flag.  The id
    set is a top-k of at most ``limit`` rows: up to ``BROADCAST_ID_LIMIT``
    it is broadcast (the big side is never shuffled); above, the join is left
    to AQE, which decides from the measured size.
    """
    broker = params.parse_int_text(broker_id, "broker_id")
    delta = params.check_percent_delta(percent_delta)
    n = params.check_limit(limit)
    if validate:
        _require_any(listings, F.col("brokered_by") == broker, f"broker {broker}")
    chosen = first_listings_of_broker(listings, broker, n, skip_null_price).withColumn("_upd", F.lit(True))
    flagged = listings.join(F.broadcast(chosen) if n <= BROADCAST_ID_LIMIT else chosen, "listing_id", "left")
    upd = F.coalesce(F.col("_upd"), F.lit(False))
    cols = [F.when(upd, adjust_price(delta)).otherwise(F.col("price")).alias("price") if c == "price"
            else F.col(c) for c in listings.columns]
    return flagged.select(*cols, upd.alias("updated"))


def uc2_changed_rows(listings: DataFrame, broker_id: str = DEFAULT_BROKER_ID,
                     percent_delta: float = DEFAULT_PERCENT_DELTA, limit: int = DEFAULT_LIMIT,
                     skip_null_price: bool = False, validate: bool = False) -> DataFrame:
    """Only the changed rows of ``uc2_update_prices``: one scan with the broker
    filter pushed down and a top-k that carries all columns, no join."""
    broker = params.parse_int_text(broker_id, "broker_id")
    delta = params.check_percent_delta(percent_delta)
    n = params.check_limit(limit)
    cond = F.col("brokered_by") == broker
    if validate:
        _require_any(listings, cond, f"broker {broker}")
    if skip_null_price:
        cond = cond & F.col("price").isNotNull()
    return listings.where(cond).orderBy("listing_id").limit(n).withColumn("price", adjust_price(delta))


def uc3_add_solar_panels(listings: DataFrame) -> DataFrame:
    """Add (or refill) ``solar_panels`` with a reproducible ~50% boolean."""
    return listings.withColumn("solar_panels", random_flag("listing_id"))


def _sorted_once(rows: DataFrame, *order) -> DataFrame:
    """Few rows of a large table in order.  A sort samples its input before it
    reads it, so the rows found are dealt out first: the table is scanned once
    and the sample comes from them."""
    return rows.hint("rebalance").orderBy(*order)


def uc4_below_threshold(listings: DataFrame, postal_code: str = DEFAULT_POSTAL_CODE,
                        below_avg_pct: float = DEFAULT_BELOW_AVG_PCT,
                        require_positive_price: bool = True, validate: bool = False) -> DataFrame:
    """Listings of one zip whose price/m2 is strictly below (1 - pct) x the zip average.

    The average is a per-zip aggregate joined back on ``zip_code`` (an
    equi-join, no cartesian product).  Both sides are filtered to the one zip
    first, so the aggregate side has at most one row and the broadcast is
    bounded by construction.
    """
    z = params.parse_int_text(postal_code, "postal_code")
    pct = params.check_below_avg_pct(below_avg_pct)
    if validate:
        _require_any(listings, F.col("zip_code") == z, f"zip code {z}")
    in_zip = eligible_for_ratio(listings.where(F.col("zip_code") == z), require_positive_price) \
        .withColumn("price_per_sqm", price_per_sqm())
    zip_avg = in_zip.groupBy("zip_code").agg(F.avg("price_per_sqm").alias("_zip_avg"))
    return (in_zip.join(F.broadcast(zip_avg), "zip_code")
            .where((F.col("_zip_avg") > 0) & (F.col("price_per_sqm") < F.col("_zip_avg") * (1.0 - pct)))
            .select(*listings.columns, "price_per_sqm")
            .transform(_sorted_once, "price_per_sqm", "listing_id"))


def uc4_sorted_by_city(listings: DataFrame, city: str = DEFAULT_CITY, state: str | None = None,
                       require_positive_price: bool = True, validate: bool = False) -> DataFrame:
    """Listings of a city (case-insensitive, trimmed; optional state), cheapest first."""
    c = params.check_city(city)
    cond = norm_text("city") == c.lower()
    if state is not None and state.strip():
        cond = cond & (norm_text("state") == state.strip().lower())
    if validate:
        _require_any(listings, cond, f"city {c}")
    if require_positive_price:
        cond = cond & (F.col("price") > 0)
    return _sorted_once(listings.where(cond), F.col("price").asc_nulls_last(), "listing_id")


def uc4_price_analysis(listings: DataFrame, postal_code: str = DEFAULT_POSTAL_CODE,
                       below_avg_pct: float = DEFAULT_BELOW_AVG_PCT, city: str = DEFAULT_CITY,
                       state: str | None = None, require_positive_price: bool = True,
                       validate: bool = False) -> dict[str, DataFrame]:
    """Both parts of UC4; ``require_positive_price`` and ``validate`` hold for each."""
    return {
        "below_threshold": uc4_below_threshold(listings, postal_code, below_avg_pct, require_positive_price, validate),
        "sorted_by_city": uc4_sorted_by_city(listings, city, state, require_positive_price, validate),
    }


def uc4_json_rows(listings: DataFrame, postal_code: str = DEFAULT_POSTAL_CODE,
                  below_avg_pct: float = DEFAULT_BELOW_AVG_PCT, city: str = DEFAULT_CITY,
                  state: str | None = None, require_positive_price: bool = True,
                  validate: bool = False) -> DataFrame:
    """Both UC4 result lists as JSON documents, one row per listing.

    Columns: ``part`` ('below_threshold' / 'sorted_by_city'), ``sort_value``
    (price per m2 / price), ``listing_id``, ``doc`` (JSON object, NULL fields
    written as ``null``).  Ordering by
    (part, sort_value, listing_id) gives the two lists; they are never
    gathered into one row, so a zip or city with millions of listings stays
    distributed.
    """
    parts = uc4_price_analysis(listings, postal_code, below_avg_pct, city, state, require_positive_price, validate)
    bt, sc = parts["below_threshold"], parts["sorted_by_city"]

    def as_docs(df: DataFrame, part: str, sort_col: str) -> DataFrame:
        return df.select(F.lit(part).alias("part"), F.col(sort_col).alias("sort_value"), "listing_id",
                         F.to_json(F.struct(*[F.col(c) for c in df.columns]),
                                   {"ignoreNullFields": "false"}).alias("doc"))

    return as_docs(bt, "below_threshold", "price_per_sqm").unionByName(as_docs(sc, "sorted_by_city", "price"))


def uc5_avg_price_per_city(listings: DataFrame, require_positive_price: bool = True) -> DataFrame:
    """Average price per m2 per (city, state), cities without eligible rows dropped."""
    return (eligible_for_ratio(listings, require_positive_price)
            .where(F.col("city").isNotNull() & F.col("state").isNotNull())
            .groupBy("city", "state")
            .agg(F.avg(price_per_sqm()).alias("avg_price_per_sqm"))
            .where(F.col("avg_price_per_sqm").isNotNull())
            .select(city_key().alias("city_state"), "city", "state", "avg_price_per_sqm")
            .orderBy("state", "city"))


def uc6_filter_by_bedrooms_and_size(listings: DataFrame, min_bedrooms: int = DEFAULT_MIN_BEDROOMS,
                                    max_size: float = DEFAULT_MAX_SIZE_SQM) -> DataFrame:
    """bed > n and house_size < m, both strict; nulls never match."""
    n = params.check_min_bedrooms(min_bedrooms)
    m = params.check_max_size(max_size)
    return listings.where((F.col("bed") > n) & (F.col("house_size_sqm") < m))


def top_n_per_broker(listings: DataFrame, n: int = DEFAULT_LIMIT, method: str = "auto") -> DataFrame:
    """The first ``n`` listings (ascending id) of every broker, with their rank.

    Small n: ``row_number() <= n`` over a broker window, planned with a
    partial window-group limit before the shuffle (a broker holding a third
    of the rows ships at most n rows per input task).  Large n: the
    distributed rank of ``ranking.top_n_per_group`` (no broker in one task).
    """
    from domus.operators.ranking import top_n_per_group
    n = params.check_limit(n)
    return top_n_per_group(listings, ["brokered_by"], ["listing_id"], n, "rank_in_broker", method)
