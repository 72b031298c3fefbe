"""Pattern matches with code point offsets, by DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from domus.llm.common import cut

Rule = tuple[str, str, tuple[str, ...]]  # kind, Java pattern, strings of which a match needs one


def find_spans(df: DataFrame, keys: Sequence[str], rules: Sequence[Rule], text: str = "text",
               context: int = 0) -> DataFrame:
    """(keys..., kind, start, end, value[, before, after]): leftmost non-overlapping
    matches of each rule in ``text``; start and end count code points, end
    exclusive.

    The texts between the matches come from ``split``, the matches from
    ``regexp_extract_all``; a match starts where the lengths of all that
    stands before it add up to.  Lengths are summed in a window over one
    row key, so a group is one document's matches.  Rows with equal keys must
    have equal texts; they give one set of matches.  ``context`` adds the
    last characters before a match and the first ones after it, up to the
    matches of the same rule next to it.  Null or empty texts have no matches.
    """
    keys = list(keys)
    found = []
    for kind, rx, need in rules:
        vals = F.regexp_extract_all(F.col(text), F.lit(rx), F.lit(0))
        if need:
            vals = F.when(reduce(or_, [F.contains(F.col(text), F.lit(n)) for n in need]), vals)
        found.append(F.struct(F.lit(kind).alias("kind"), vals.alias("vals")))
    hits = df.select(*keys, text, F.inline(F.array(*found))).where(F.size("vals") > 0)
    pieces = F.lit(None).cast("array<string>")
    for kind, rx, _ in rules:
        pieces = F.when(F.col("kind") == kind, F.split(F.col(text), rx, -1)).otherwise(pieces)
    rows = hits.select(*keys, "kind", F.posexplode(
        F.arrays_zip(F.slice(pieces, 1, F.size("vals")).alias("piece"), F.col("vals").alias("value"), *(
            [F.transform(F.slice(pieces, 2, F.size("vals")), lambda x: F.substring(x, 1, context)).alias("after")]
            if context else []))))
    cols = [F.length("col.piece").alias("gap"), F.col("col.value").alias("value")]
    if context:
        cols.append(F.substring(F.col("col.piece"), -context, context).alias("before"))
        cols.append(F.coalesce("col.after", F.lit("")).alias("after"))
    rows = rows.select(*keys, "kind", "pos", *cols).distinct()
    w = Window.partitionBy(*keys, "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("value")).over(w)
    rows = rows.withColumn("end", end).withColumn("start", F.col("end") - F.length("value"))
    return rows.select(*keys, "kind", "start", "end", "value", *(["before", "after"] if context else []))


def span_digest(df: DataFrame, keys: Sequence[str], kinds: Sequence[str]) -> DataFrame:
    """One row per key: n_<kind> and base text of base rows, text of all rows.

    ``df`` has keys, kind, start, end, base (boolean).  The texts are
    kind:start:end by start, then kind in the order of ``kinds``.
    """
    order = F.coalesce(*[F.when(F.col("kind") == k, F.lit(i)) for i, k in enumerate(kinds)])
    item = F.struct("start", order.alias("ord"), "end", "kind")

    def joined(c: str) -> Column:
        return F.array_join(F.transform(F.array_sort(F.col(c)), lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    counts = [F.count(F.when(F.col("base") & (F.col("kind") == k), 1)).alias(f"n_{k}") for k in kinds]
    return df.groupBy(*keys).agg(*counts, F.collect_list(F.when(F.col("base"), item)).alias("b"),
                                 F.collect_list(item).alias("a")) \
        .select(*keys, *[f"n_{k}" for k in kinds], joined("b").alias("base_spans"), joined("a").alias("spans"))


def with_digest(docs: DataFrame, digest: DataFrame, keys: Sequence[str], kinds: Sequence[str]) -> DataFrame:
    """Join a digest back to all rows of ``docs``; rows without spans get zeros
    and the empty text.  Keys match null-safely.  The digest is written first,
    so that the join can split a key that many rows share."""
    keys, digest = list(keys), cut(digest, "span-digest")
    right = digest.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in digest.columns if c not in keys])
    cond = None
    for k in keys:
        c = docs[k].eqNullSafe(right[f"_k_{k}"])
        cond = c if cond is None else cond & c
    return docs.join(right, cond, "left").select(
        *docs.columns, *[F.coalesce(F.col(f"n_{k}"), F.lit(0)).alias(f"n_{k}") for k in kinds],
        F.coalesce("base_spans", F.lit("")).alias("base_spans"), F.coalesce("spans", F.lit("")).alias("spans"))
