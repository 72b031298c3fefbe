"""Cleaning of the raw export and typed parsing of the cleaned CSV.

Both are single-pass column expressions (vectorized, codegen'd) plus one
aggregate for keep-first deduplication; invalid rows go to a rejects frame
with one reason per failed field instead of being dropped silently.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from domus.functions.parse import (
    to_double, to_int_strict, whole_number, with_sold_date, year_after, year_between,
)
from domus.functions.text import null_if_token, strip, title_case
from domus.operators.joins import first_per_group
from domus.schema import (
    ACRE_TO_SQM, CLEANER_MIN_EXCLUSIVE_YEAR, CLEANER_NULL_TOKENS, DEDUP_KEYS, PARSER_DATE_NULL_TOKENS,
    REQUIRED_FIELDS, SQFT_TO_SQM,
)


def _opt(df: DataFrame, name: str) -> Column:
    """Column if the input has it, else a typed NULL (a file without that column)."""
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


# ---------------------------------------------------------------- F8
def convert_units(raw: DataFrame) -> DataFrame:
    """acre_lot -> lot_size_sqm (x 4046.8564224), house_size -> house_size_sqm (x 0.09290304)."""
    lot = to_double(_opt(raw, "acre_lot")) * F.lit(ACRE_TO_SQM)
    house = to_double(_opt(raw, "house_size")) * F.lit(SQFT_TO_SQM)
    rest = [c for c in raw.columns if c not in ("acre_lot", "house_size")]
    return raw.select(*rest, lot.alias("lot_size_sqm"), house.alias("house_size_sqm"))


# ---------------------------------------------------------------- full clean
def clean_raw(raw: DataFrame, order_cols=("src_pos",), narrow: bool = False) -> DataFrame:
    """Raw listing export -> cleaned listings.

    Steps: unit conversion; date parse to UTC, years <= 1970 dropped to NULL;
    null tokens on text fields; city title case; drop rows missing a
    mandatory field; numeric typing (beds/baths/zip integral); keep the first
    row (by ``order_cols``, the source position) of each duplicate group on the six dedup keys,
    nulls comparing equal.  ``narrow`` reproduces float32 storage of the
    money/area columns (lossy above 2^24).
    """
    df = convert_units(raw)
    df = with_sold_date(df, _opt(df, "prev_sold_date"))
    order_cols = [order_cols] if isinstance(order_cols, str) else list(order_cols)
    # numbers and tokens in a projection of their own, as the next one uses each several times
    read = df.select(
        *order_cols, "lot_size_sqm", "house_size_sqm", "_sold",
        *[to_double(_opt(df, c)).alias(c) for c in ("brokered_by", "price", "bed", "bath", "street", "zip_code")],
        *[null_if_token(_opt(df, c), CLEANER_NULL_TOKENS).alias(c) for c in ("status", "city", "state")],
    )

    def num(c: str) -> Column:
        return (F.col(c).cast("float").cast("double") if narrow else F.col(c)).alias(c)

    typed = read.select(
        *order_cols,
        num("brokered_by"),
        "status",
        num("price"),
        whole_number(F.col("bed"), "int").alias("bed"),
        whole_number(F.col("bath"), "int").alias("bath"),
        num("lot_size_sqm"),
        num("street"),
        title_case("city").alias("city"),
        "state",
        whole_number(F.col("zip_code"), "bigint").alias("zip_code"),
        num("house_size_sqm"),
        year_after(F.col("_sold"), CLEANER_MIN_EXCLUSIVE_YEAR).alias("prev_sold_date"),
    )
    # a mandatory field that the file doesn't have at all can't be asked of its rows
    present = {*raw.columns, *(["lot_size_sqm"] if "acre_lot" in raw.columns else []),
               *(["house_size_sqm"] if "house_size" in raw.columns else [])}
    complete = F.lit(True)
    for c in REQUIRED_FIELDS:
        if c in present:
            complete = complete & F.col(c).isNotNull()
    return first_per_group(typed, list(DEDUP_KEYS), order_cols, where=complete)


def format_clean_csv(clean: DataFrame) -> DataFrame:
    """Cleaned rows as CSV text: '%.2f' floats, 'yyyy-MM-dd HH:mm:ss' dates, NULL -> ''."""
    out = []
    for f in clean.schema.fields:
        c = F.col(f.name)
        t = f.dataType.simpleString()
        if t in ("double", "float"):
            txt = F.format_string("%.2f", c)
        elif t.startswith("timestamp"):
            txt = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        else:
            txt = c.cast("string")
        out.append(F.when(c.isNotNull(), txt).otherwise(F.lit("")).alias(f.name))
    return clean.select(*out)


# ---------------------------------------------------------------- record parser
def _parse_columns(text: DataFrame) -> list[Column]:
    """Of text that has ``_sold`` (``with_sold_date``)."""
    return [
        to_double(_opt(text, "brokered_by")).alias("brokered_by"),
        strip(_opt(text, "status")).alias("status"),
        to_double(_opt(text, "price")).alias("price"),
        to_double(_opt(text, "lot_size_sqm")).alias("lot_size_sqm"),
        to_double(_opt(text, "street")).alias("street"),
        title_case(_opt(text, "city")).alias("city"),
        title_case(_opt(text, "state")).alias("state"),
        to_int_strict(_opt(text, "zip_code")).alias("zip_code"),
        to_int_strict(_opt(text, "bed")).alias("bed"),
        to_int_strict(_opt(text, "bath")).alias("bath"),
        to_double(_opt(text, "house_size_sqm")).alias("house_size_sqm"),
        year_between(F.col("_sold")).alias("prev_sold_date"),
    ]


def _reasons() -> Column:
    def missing(c: str) -> Column:
        return F.col(c).isNull()

    def blank(c: str) -> Column:
        return F.col(c).isNull() | (F.col(c) == "")

    def no_int(c: str) -> Column:
        return F.col(c).try_cast("int").isNull()

    checks = [
        ("brokered_by", no_int), ("status", blank), ("price", missing), ("lot_size_sqm", missing),
        ("street", missing), ("city", blank), ("state", blank), ("zip_code", missing),
    ]
    return F.array_compact(F.array(*[F.when(fn(name), F.lit(name)) for name, fn in checks]))


def parse_listings_with_reasons(text: DataFrame, order_col: str = "src_pos", keep: Sequence[str] = ()) -> DataFrame:
    """Typed record columns plus ``reasons`` (array of failed mandatory fields) and the
    columns to ``keep``."""
    dated = with_sold_date(text, _opt(text, "prev_sold_date"), PARSER_DATE_NULL_TOKENS, iso=True)
    parsed = dated.select(F.col(order_col), *_parse_columns(dated), *keep)
    return parsed.withColumn("reasons", _reasons())


def parse_listings(text: DataFrame, order_col: str = "src_pos") -> tuple[DataFrame, DataFrame]:
    """Cleaned-CSV text -> (valid typed records, rejects with reasons).

    One pass computes the typed columns and the reasons; both outputs filter
    the same lazily defined frame (cache or write it when both are consumed).
    The rows' places are asked for too: without them the filter is moved below
    the projections and works every field out a second time.
    """
    parsed = parse_listings_with_reasons(text, order_col).withColumn("_at", F.monotonically_increasing_id())
    valid = parsed.where((F.size("reasons") == 0) & (F.col("_at") >= 0)).drop("reasons", "_at")
    rejects = parsed.where((F.size("reasons") > 0) & (F.col("_at") >= 0)) \
        .select(order_col, F.array_join("reasons", ",").alias("reasons"))
    return valid, rejects


def to_wide_listing(records: DataFrame, id_col: str = "src_pos", keep: Sequence[str] = ()) -> DataFrame:
    """Typed records -> wide listing schema (id from the source position)."""
    return records.select(
        F.col(id_col).cast("bigint").alias("listing_id"),
        F.col("brokered_by").try_cast("int").alias("brokered_by"),
        "status", "price", "lot_size_sqm", "street", "city", "state",
        F.col("zip_code").cast("int").alias("zip_code"), "bed", "bath", "house_size_sqm",
        F.col("prev_sold_date").cast("date").alias("prev_sold_date"), *keep,
    )
