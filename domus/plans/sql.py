"""The listing questions as Spark SQL over temp views.

``register_views`` exposes a wide listing frame (and optionally the star
tables) as temp views; the statements below are the relational forms of the
use cases.  Catalyst plans them exactly like the DataFrame operators: the
tuple ``IN (subquery)`` of UC1 becomes a left-semi join, the HAVING a filter
over a partial/final aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def register_views(spark: SparkSession, listings: DataFrame, star: dict[str, DataFrame] | None = None,
                   prefix: str = "") -> None:
    listings.createOrReplaceTempView(f"{prefix}listings_wide")
    for name, df in (star or {}).items():
        df.createOrReplaceTempView(f"{prefix}{name}")


UC1_SQL = """
SELECT *
FROM {listings}
WHERE city IS NOT NULL AND state IS NOT NULL
  AND (city, state) IN (SELECT city, state FROM {listings}
                        WHERE city IS NOT NULL AND state IS NOT NULL
                        GROUP BY city, state HAVING count(*) > {min_listings})
  AND price < {max_price}
ORDER BY city, state, price, listing_id
"""

UC5_SQL = """
SELECT concat_ws(', ', city, state) AS city_state, city, state,
       avg(price / nullif(lot_size_sqm, 0)) AS avg_price_per_sqm
FROM {listings}
WHERE lot_size_sqm > 0 AND price > 0 AND city IS NOT NULL AND state IS NOT NULL
GROUP BY city, state
HAVING avg(price / nullif(lot_size_sqm, 0)) IS NOT NULL
ORDER BY state, city
"""


def uc1_sql(spark: SparkSession, min_listings: int, max_price: float, view: str = "listings_wide") -> DataFrame:
    return spark.sql(UC1_SQL.format(listings=view, min_listings=int(min_listings), max_price=float(max_price)))


def uc5_sql(spark: SparkSession, view: str = "listings_wide") -> DataFrame:
    return spark.sql(UC5_SQL.format(listings=view))
