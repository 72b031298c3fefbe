"""Text-typed listing exports derived from the driver tables.

The cleaning and parsing operators consume text files (the raw listing
export, the cleaned CSV).  To run them over the given tables, these frames
render the listing projection as text and inject the defects those operators
exist for, by fixed rules on the listing id: blanks, "nan" tokens, mixed case
and padding, "3.0" integers, unparseable or pre-1970 dates, zone offsets, and
duplicated listings.  Every listing is kept (plus the duplicates); nothing is
filtered.  ``src_pos`` is the row's position in the export (file order).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from domus.sources.tables import listings_from_tables


def _every(k: Column, n: int) -> Column:
    return (k % n) == 0


def _txt(c: str) -> Column:
    return F.col(c).cast("string")


def _dirty_text(listings: DataFrame, layout: str) -> DataFrame:
    k = F.col("listing_id")
    # listings with id % 41 == 0 appear twice (one pass, a generator per row);
    # the copy differs only in bed
    copies = F.when(_every(k, 41), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = (listings.withColumn("_copy", F.explode(copies))
            .withColumn("bed", F.when(F.col("_copy") == 1, F.col("bed") + 1).otherwise(F.col("bed"))))

    date_txt = F.date_format("prev_sold_date", "yyyy-MM-dd")
    sold = (F.when(_every(k, 7), F.lit(""))
            .when(_every(k, 19), F.lit("not a date"))
            .when(_every(k, 23), F.lit("1969-05-01"))
            .when(_every(k, 29), F.concat(date_txt, F.lit("T00:00:00+02:00"))))
    if layout == "clean_csv":  # forms that only the record parser has rules for
        sold = (sold.when(_every(k, 59), F.date_format("prev_sold_date", "yyyyMMdd"))
                .when(_every(k, 61), F.date_format("prev_sold_date", "yyyy-MM"))
                .when(_every(k, 67), F.concat(date_txt, F.lit(" 13:45:10"))))
    sold = sold.otherwise(date_txt)
    city = (F.when(_every(k, 31), F.lit(""))
            .when(_every(k, 79), F.concat(F.lit("\t"), F.col("city"), F.lit("\t ")))
            .when(k % 5 == 1, F.lower("city"))
            .when(k % 5 == 2, F.concat(F.lit(" "), F.lower("city"), F.lit(" ")))
            .when(k % 5 == 3, F.upper("city"))
            .otherwise(F.col("city")))
    state = F.when(k % 3 == 1, F.lower("state")).otherwise(F.col("state"))
    status = (F.when(_every(k, 97), F.lit("nan"))
              .when(_every(k, 89), F.lit(""))
              .otherwise(F.col("status")))
    amount = F.format_string("%.2f", "price")
    price = (F.when(_every(k, 37), F.lit("nan")).when(_every(k, 71), F.concat(amount, F.lit("d")))
             .when(_every(k, 83), F.lit("0x1p3")).otherwise(amount))
    broker = F.when(_every(k, 53), F.lit("")).otherwise(F.concat(_txt("brokered_by"), F.lit(".0")))
    bed = (F.when(F.col("bed").isNull(), F.lit(""))
           .when(_every(k, 11), F.concat(_txt("bed"), F.lit(".0")))
           .otherwise(_txt("bed")))
    bath = F.coalesce(_txt("bath"), F.lit(""))
    zip_code = F.when(_every(k, 13), F.concat(_txt("zip_code"), F.lit(".0"))).otherwise(_txt("zip_code"))
    street = F.format_string("%.1f", "street")
    if layout == "raw":
        lot = (F.when(F.col("lot_size_sqm").isNull(), F.lit(""))
               .when(_every(k, 43), F.lit("abc"))
               .otherwise(F.format_string("%.4f", F.col("lot_size_sqm") / 100.0)))
        house = F.when(F.col("house_size_sqm").isNull(), F.lit("")) \
            .otherwise(F.format_string("%.1f", F.col("house_size_sqm") * 10.0))
        names = ("acre_lot", "house_size")
    else:
        lot = (F.when(F.col("lot_size_sqm").isNull(), F.lit(""))
               .when(_every(k, 43), F.lit("abc"))
               .otherwise(F.format_string("%.2f", "lot_size_sqm")))
        house = F.when(F.col("house_size_sqm").isNull(), F.lit("")) \
            .otherwise(F.format_string("%.2f", "house_size_sqm"))
        names = ("lot_size_sqm", "house_size_sqm")
    return rows.select(
        (k * 2 + F.col("_copy")).alias("src_pos"),
        broker.alias("brokered_by"), status.alias("status"), price.alias("price"),
        bed.alias("bed"), bath.alias("bath"), lot.alias(names[0]), street.alias("street"),
        city.alias("city"), state.alias("state"), zip_code.alias("zip_code"),
        house.alias(names[1]), sold.alias("prev_sold_date"),
    )


def raw_listings_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw listing export (acres, square feet), all text, with defects."""
    return _dirty_text(listings_from_tables(spark, sf_dir), "raw")


def clean_csv_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned-CSV layout (m2 areas), all text, with defects for the parser."""
    return _dirty_text(listings_from_tables(spark, sf_dir), "clean_csv")
