"""Join building blocks.

* ``bounded_broadcast`` broadcasts a side only after proving it has at most
  ``max_rows`` rows (a bounded ``limit(max_rows + 1).count()``); beyond the
  bound the side is returned unchanged and Spark plans a shuffle join, which
  AQE may still convert at runtime from measured sizes.
* ``first_per_group`` keeps one row per key by a min-over-struct aggregate,
  which runs map-side partial aggregation: a key holding a third of the rows
  is reduced inside every input task before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Probe results per (plan, input files, bound) for this driver process: input
# files are immutable, so a repeated probe of the same frame needs no new job.
_PROBES: dict[tuple, bool] = {}


def bounded_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """``broadcast(df)`` if df provably has <= max_rows rows, else df."""
    try:
        key = (df.semanticHash(), tuple(sorted(df.inputFiles())), max_rows)
    except Exception:  # a frame without a stable identity: always probe
        key = None
    small = _PROBES.get(key) if key is not None else None
    if small is None:
        small = df.limit(max_rows + 1).count() <= max_rows
        if key is not None:
            _PROBES[key] = small
    return F.broadcast(df) if small else df


def null_safe_match(left: DataFrame, right: DataFrame, keys: Sequence[str],
                    null_safe_keys: Sequence[str] = (), how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` plus null-safe equality (``<=>``) on ``null_safe_keys``.

    Stays a hash / sort-merge join: Spark plans ``<=>`` as an equi-join key.
    Both sides keep their own column names; the right side's key columns are
    dropped from the output.
    """
    all_keys = list(keys) + list(null_safe_keys)
    r = right.select(*[F.col(c).alias(f"_r_{c}") if c in all_keys else F.col(c) for c in right.columns])
    cond = None
    for k in all_keys:
        c = left[k].eqNullSafe(r[f"_r_{k}"]) if k in null_safe_keys else left[k] == r[f"_r_{k}"]
        cond = c if cond is None else cond & c
    return left.join(r, cond, how).drop(*[f"_r_{k}" for k in all_keys])


def first_per_group(df: DataFrame, keys: Sequence[str], order_by: Sequence[str | Column],
                    nulls_last: bool = True, where: Column | None = None) -> DataFrame:
    """One row per ``keys``: the row that sorts first by ``order_by`` (ascending).

    Ties on ``order_by`` are broken by the remaining columns, so the result is
    deterministic.  With ``nulls_last`` a null sorts after every value (the
    relational default for ascending order).  Only rows that meet ``where`` are
    taken; it is asked inside the aggregate, because a filter before it is moved
    below the projections, where all that it asks for is worked out twice.
    """
    payload = [c for c in df.columns if c not in keys]
    order_fields = []
    for i, c in enumerate(order_by):
        col = F.col(c) if isinstance(c, str) else c
        if nulls_last:
            order_fields.append(col.isNull().alias(f"_n{i}"))
        order_fields.append(col.alias(f"_o{i}"))
    row = F.struct(*order_fields, F.struct(*payload).alias("_row"))
    best = df.groupBy(*keys).agg(F.min(row if where is None else F.when(where, row)).alias("_best"))
    if where is not None:
        best = best.where("_best is not null")
    return best.select(*keys, "_best._row.*").select(*df.columns)

