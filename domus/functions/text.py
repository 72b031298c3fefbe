"""Text normalization expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# what Unicode calls white space, and the four separators of ASCII
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
# ASCII text whose words start after blanks only: ``initcap`` alone is right there
PLAIN_WORDS = r"^[A-Za-z ]*[^A-Za-z\x{80}-\x{10ffff}]*$"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends (``trim`` takes blanks only)."""
    inside = F.substring(c, 1, 1).between("!", "~") & F.substring(c, -1, 1).between("!", "~")
    return F.when(inside, c).otherwise(F.btrim(c, F.lit(WHITE)))


def title_case(c: str | Column) -> Column:
    """trim + title case with word starts after any non-letter.

    ``initcap`` only starts words after spaces ("Winston-salem"); splitting
    into letter / non-letter runs and capitalizing each letter run gives
    "Winston-Salem", "O'Fallon", "1St" — the usual title-case rule.
    """
    t = strip(_c(c))
    runs = F.regexp_extract_all(t, F.lit(r"(\p{L}+|\P{L}+)"), 1)
    out = F.array_join(F.transform(runs, lambda r: F.initcap(r)), "")
    return F.when(t.rlike(PLAIN_WORDS), F.initcap(t)).when(_c(c).isNotNull(), out)


def null_if_token(c: str | Column, tokens: Iterable[str]) -> Column:
    """Stripped text, or NULL if it is one of ``tokens``."""
    t = strip(_c(c))
    return F.when(~t.isin(list(tokens)), t)


def hash_id(*cols: str | Column) -> Column:
    """Deterministic 60-bit id from the md5 of the '|'-joined text of ``cols``."""
    text = F.concat_ws("|", *[_c(c).cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")
