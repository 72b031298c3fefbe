"""Typed parsing of text columns with built-in expressions (no Python UDFs)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from domus.functions.text import strip
from domus.schema import MAX_SOLD_YEAR, MIN_SOLD_YEAR


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def to_double(c: str | Column) -> Column:
    """Text -> double; blank, invalid (also "12d", "0x1p3") and NaN -> NULL."""
    t = strip(_c(c))
    return F.when(t.rlike(NUMBER), t.try_cast("double"))


def to_int_strict(c: str | Column) -> Column:
    """Text -> int, digits only ("3.0" and "abc" -> NULL, " 12 " -> 12)."""
    t = strip(_c(c))
    return F.when(t.rlike(r"^[+-]?[0-9]+$"), t.try_cast("int"))


def to_int_numeric(c: str | Column) -> Column:
    """Text -> int via a number: "3.0" -> 3; fractional or invalid -> NULL."""
    return whole_number(to_double(c), "int")


def to_long_numeric(c: str | Column) -> Column:
    return whole_number(to_double(c), "bigint")


def whole_number(d: Column, kind: str) -> Column:
    """A double as an integer; fractional or out of range -> NULL."""
    return F.when(d == F.floor(d), d.try_cast(kind))


def iso_date_text(c: str | Column) -> Column:
    """The text if it starts with a whole ISO date, yyyyMMdd written with dashes,
    else NULL: a year, a month or parts without leading zeros are no date."""
    return whole_date(dashed_date(c))


def dashed_date(c: str | Column) -> Column:
    """Stripped text, yyyyMMdd at its start written with dashes."""
    return F.regexp_replace(strip(_c(c)), r"^([0-9]{4})([0-9]{2})([0-9]{2})(?=$|[T ])", "$1-$2-$3")


def whole_date(t: Column) -> Column:
    """Stripped text if it starts with a whole ISO date, else NULL."""
    return F.when(t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}($|[T ])"), t)


def to_utc_timestamp_ntz(c: str | Column, null_tokens: Iterable[str] = ()) -> Column:
    """ISO date / date-time text -> naive UTC timestamp; offsets converted; bad -> NULL.

    Independent of the session time zone: text without a zone is read as a
    naive wall clock (``TIMESTAMP_NTZ``); text with a zone designator (Z or
    +hh:mm) is read as an instant and converted to the UTC wall clock.
    """
    return utc_of_text(strip(_c(c)), null_tokens)


def utc_of_text(t: Column, null_tokens: Iterable[str] = ()) -> Column:
    """``to_utc_timestamp_ntz`` of stripped text."""
    zoned = t.rlike(r"(Z|[+-][0-9]{2}(:?[0-9]{2})?)$") & t.rlike(r"[0-9]T|[0-9] [0-9]")
    instant = F.try_to_timestamp(t)
    utc = F.convert_timezone(None, F.lit("UTC"), instant.cast("timestamp_ntz"))
    out = F.when(zoned, utc).otherwise(t.try_cast("timestamp_ntz"))
    tokens = list(null_tokens)
    return F.when(~t.isin(tokens), out) if tokens else out


def year_between(ts: Column, lo: int = MIN_SOLD_YEAR, hi: int = MAX_SOLD_YEAR) -> Column:
    return F.when(F.year(ts).between(lo, hi), ts)


def year_after(ts: Column, lo_exclusive: int) -> Column:
    return F.when(F.year(ts) > lo_exclusive, ts)


def with_sold_date(df: DataFrame, text: Column, null_tokens: Iterable[str] = (), iso: bool = False) -> DataFrame:
    """``df`` with ``_sold``, the UTC time of ``text`` (with ``iso`` only of whole ISO dates).

    A projection for each step: every rule uses what the one before gives
    several times, and inside one expression each use is worked out anew.
    """
    out = df.withColumn("_sold_text", dashed_date(text) if iso else strip(text))
    if iso:
        out = out.withColumn("_sold_text", whole_date(F.col("_sold_text")))
    return out.withColumn("_sold", utc_of_text(F.col("_sold_text"), null_tokens)).drop("_sold_text")
