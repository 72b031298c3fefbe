"""Driver-side parameter parsing and checks of the use-case contract.

Broker and zip arguments arrive as text such as "22611.00"; they are read
with ``int(float(x))``.  Checks raise ``ValueError`` (no silent empty result).
"""

from __future__ import annotations


def parse_int_text(value, name: str) -> int:
    try:
        return int(float(str(value).strip()))
    except (TypeError, ValueError):
        raise ValueError(f"invalid {name}: {value!r}") from None


def check_min_listings(n) -> int:
    if not isinstance(n, int) or isinstance(n, bool) or n < 0:
        raise ValueError("min_listings must be a non-negative integer")
    return n


def check_max_price(p) -> float:
    if not isinstance(p, (int, float)) or isinstance(p, bool) or p < 0:
        raise ValueError("max_price must be a non-negative number")
    return float(p)


def check_percent_delta(d) -> float:
    if not isinstance(d, (int, float)) or isinstance(d, bool):
        raise ValueError("percent_delta must be a number")
    if d <= -1.0:
        raise ValueError("percent_delta must be greater than -1")
    return float(d)


def check_limit(n) -> int:
    if not isinstance(n, int) or isinstance(n, bool) or n <= 0:
        raise ValueError("limit must be a positive integer")
    return n


def check_below_avg_pct(p) -> float:
    if not isinstance(p, (int, float)) or isinstance(p, bool) or not (0 < p < 1):
        raise ValueError("below_avg_pct must be strictly between 0 and 1")
    return float(p)


def check_city(city) -> str:
    if not isinstance(city, str) or not city.strip():
        raise ValueError("city must be a non-empty string")
    return city.strip()


def check_min_bedrooms(n) -> int:
    if not isinstance(n, int) or isinstance(n, bool) or n < 0:
        raise ValueError("min_bedrooms must be a non-negative integer")
    return n


def check_max_size(s) -> float:
    if not isinstance(s, (int, float)) or isinstance(s, bool) or s <= 0:
        raise ValueError("max_size must be a positive number")
    return float(s)
