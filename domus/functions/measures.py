"""Column expressions for listing measures (all JVM-side, codegen'd)."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from domus.functions.text import strip


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def price_per_sqm(price: str | Column = "price", area: str | Column = "lot_size_sqm") -> Column:
    """price / area with the zero guard inside the expression.

    ANSI mode raises on division by zero, so a filter in front is not enough
    (Catalyst may evaluate the projection before or after it).
    """
    return col(price).cast("double") / F.nullif(col(area).cast("double"), F.lit(0.0))


def adjust_price(percent_delta: float, price: str | Column = "price") -> Column:
    """price * (1 + delta), rounded half-up to cents in exact decimal arithmetic."""
    factor = Decimal(1) + Decimal(str(percent_delta))
    sign, digits, exponent = factor.as_tuple()
    scale = max(0, -exponent)
    whole = max(1, len(digits) + exponent)
    factor_lit = F.lit(factor).cast(f"decimal({min(38, whole + scale)},{scale})")
    return (col(price).cast("decimal(16,2)") * factor_lit).cast("decimal(16,2)").cast("double")


def random_flag(key: str | Column = "listing_id") -> Column:
    """Reproducible ~50% boolean derived from the key (same under recompute/retry)."""
    return F.substring(F.md5(col(key).cast("string")), 1, 1) < F.lit("8")


def city_key(city: str | Column = "city", state: str | Column = "state") -> Column:
    """"city, state" display key (inputs must be non-null)."""
    return F.concat_ws(", ", col(city), col(state))


def norm_text(c: str | Column) -> Column:
    """Lower-case text without white space at the ends, for case-insensitive matching."""
    return F.lower(strip(col(c)))


def round_half_up(c: str | Column, digits: int) -> Column:
    """Round half-up on the decimal value (10-digit decimal first, so float noise
    in the last bits of an aggregate cannot flip a tie)."""
    return F.round(col(c).cast("decimal(38,10)"), digits).cast("double")
