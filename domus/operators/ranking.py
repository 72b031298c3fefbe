"""Exact ranks and quantiles within groups without gathering a group in one task.

``row_number() over (partition by k order by o)`` sends every row of a key
to one task.  ``rank_within_groups`` computes the same numbers with the data
range-partitioned on (k, o), so a key holding a third of all rows is spread
over many partitions:

1. range-partition on (keys, order) and sort within partitions; each row
   gets its partition id and a monotonically increasing id (consecutive
   inside a partition in sorted order);
2. count rows per (partition, key) -- a table of at most
   partitions + keys rows -- and take running sums over the partitions of a
   key (a key spans at most ``partitions`` rows here);
3. rank = rows of the key in earlier partitions + position inside this one.

The ordered rows (with partition id and position) are written once to the
shared checkpoint folder and both the count and the join read that copy: the
range partitioner samples its input, and an input whose row order is not
fixed (any shuffle output) could otherwise be split differently on a second
evaluation.  Include an id in ``order_cols`` for a deterministic order among
ties; for quantiles ties do not matter (equal values are interchangeable).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from domus.operators.joins import bounded_broadcast, null_safe_match
from domus.session import materialize


def rank_within_groups(df: DataFrame, keys: Sequence[str], order_cols: Sequence[str],
                       rank_col: str = "rank_in_group", partitions: int | None = None) -> DataFrame:
    """Exact 1-based row number within ``keys`` by ascending ``order_cols``."""
    keys, order_cols = list(keys), list(order_cols)
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sort_cols = keys + order_cols
    ordered = materialize(df.repartitionByRange(n, *sort_cols).sortWithinPartitions(*sort_cols)
                          .withColumn("_pid", F.spark_partition_id())
                          .withColumn("_mid", F.monotonically_increasing_id()), "rank-stage")
    counts = ordered.groupBy("_pid", *keys).agg(F.count(F.lit(1)).alias("_cnt"), F.min("_mid").alias("_first"))
    w = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = counts.withColumn("_before", F.sum("_cnt").over(w) - F.col("_cnt")).drop("_cnt")
    joined = null_safe_match(ordered, offsets, ["_pid"], keys)
    ranked = joined.withColumn(rank_col, F.col("_before") + F.col("_mid") - F.col("_first") + 1)
    return ranked.drop("_pid", "_mid", "_first", "_before")


def top_n_per_group(df: DataFrame, keys: Sequence[str], order_cols: Sequence[str], n: int,
                    rank_col: str = "rank_in_group", method: str = "auto",
                    window_limit_max: int = 10_000) -> DataFrame:
    """First ``n`` rows per key.

    ``window``: ``row_number() <= n``, planned with a partial window-group
    limit (each input task keeps at most n rows per key before the shuffle):
    bounded while n is small.  ``range``: the distributed rank above, for
    large n.  ``auto`` picks ``window`` up to ``window_limit_max``.
    """
    if method == "auto":
        method = "window" if n <= window_limit_max else "range"
    if method == "window":
        w = Window.partitionBy(*keys).orderBy(*order_cols)
        return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= n)
    ranked = rank_within_groups(df, keys, order_cols, rank_col)
    return ranked.where(F.col(rank_col) <= n).withColumn(rank_col, F.col(rank_col).cast("int"))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value_col: str, probs: Sequence[float],
                    partitions: int | None = None, window_rows: int = 100_000, accuracy: int = 1000) -> DataFrame:
    """Exact interpolated quantiles (the ``percentile`` / ``quantile_cont`` rule) per key.

    Output: keys, ``prob``, ``value``; keys without a value have no row.

    Equal values are counted first and are one row from then on.  Where a key
    has more than ``window_rows`` values, one pass takes a mergeable sketch of
    each key, which brackets every quantile between two values, and a second
    pass counts the values inside a bracket one by one and everything between
    two brackets as one number; what is left to order is a small share of the
    values (6 / ``accuracy`` a quantile).  Keys with at most ``window_rows``
    values are counted whole.  Counts decide: if a quantile fell outside its
    bracket, all values are counted.

    The counts are summed up along the values in a window per key while no key
    has more than ``window_rows`` of them, else range-partitioned, so a key
    with a large share of all rows never meets in one task.
    """
    keys, probs = list(keys), [float(x) for x in probs]
    rows = df.where(F.col(value_col).isNotNull()).select(*keys, F.col(value_col).alias("_v"))
    whole = rows.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"), F.lit(None).cast("int").alias("_between"))
    if _largest(rows, keys) <= window_rows:
        around = _around(_summed(whole, keys), keys, probs)
    else:
        counted = _bracketed(rows, keys, probs, window_rows, accuracy)
        around = _around(_summed_widely(counted, keys, partitions, window_rows), keys, probs)
        if around.where("_between is not null").limit(1).count():
            counted = materialize(whole, "quantile-counts")
            around = _around(_summed_widely(counted, keys, partitions, window_rows), keys, probs)
    frac = F.first("_pos") - (F.first("_lo") - 1)
    low, high = F.min("_v"), F.max("_v")  # the values at _lo and _hi
    return around.groupBy(*keys, "prob").agg(
        F.when(low == high, low).otherwise((1 - frac) * low + frac * high).alias("value"))


def _bracketed(rows: DataFrame, keys: list[str], probs: list[float], window_rows: int,
               accuracy: int) -> DataFrame:
    """(keys, _v, _c, _between): the count of each value inside a bracket, and of
    all values between two brackets (``_between`` not null, ``_v`` the least of
    them)."""
    reach = 3.0 / accuracy  # the sketch is off by 1 / accuracy of the rows
    near = [x for p in probs for x in (max(p - reach, 0.0), min(p + reach, 1.0))]
    bounds = materialize(rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
        F.percentile_approx("_v", near, accuracy).alias("_near")), "quantile-bounds")
    narrow = F.col("_n") > window_rows
    edges = [(F.when(narrow & F.lit(p > reach), F.col("_near")[2 * i]).otherwise(F.col("_min")),
              F.when(narrow & F.lit(p < 1 - reach), F.col("_near")[2 * i + 1]).otherwise(F.col("_max")))
             for i, p in enumerate(probs)]
    edges = bounds.select(*keys, *[e.alias(f"_e{i}_{side}") for i, pair in enumerate(edges)
                                   for side, e in zip(("lo", "hi"), pair)])
    placed = null_safe_match(rows, bounded_broadcast(edges, 100_000), [], keys)
    inside, above = F.lit(False), F.lit(0)
    for i in range(len(probs)):
        inside = inside | F.col("_v").between(F.col(f"_e{i}_lo"), F.col(f"_e{i}_hi"))
        above = above + (F.col("_v") > F.col(f"_e{i}_hi")).cast("int")
    counted = placed.select(*keys, "_v", F.when(inside, F.col("_v")).alias("_cell"),
                            F.when(~inside, above).alias("_between")) \
        .groupBy(*keys, "_cell", "_between").agg(F.min("_v").alias("_v"), F.count(F.lit(1)).alias("_c")).drop("_cell")
    return materialize(counted, "quantile-counts")


def _largest(df: DataFrame, keys: list[str]) -> int:
    """Rows of the key that has most."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).agg(F.max("c")).first()[0] or 0


def _summed(counted: DataFrame, keys: list[str]) -> DataFrame:
    """``counted`` with _upto, the counts up to each value, and _n, those of the key."""
    order = Window.partitionBy(*keys).orderBy("_v")  # one order for both frames: one sort
    along = order.rowsBetween(Window.unboundedPreceding, 0)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return counted.withColumn("_upto", F.sum("_c").over(along)).withColumn("_n", F.sum("_c").over(whole))


def _summed_widely(counted: DataFrame, keys: list[str], partitions: int | None, window_rows: int) -> DataFrame:
    """``_summed``, range-partitioned if a key has more than ``window_rows`` rows."""
    if _largest(counted, keys) <= window_rows:
        return _summed(counted, keys)
    n = partitions or int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = materialize(counted.repartitionByRange(n, *keys, "_v").withColumn("_pid", F.spark_partition_id()),
                          "quantile-stage")
    order = Window.partitionBy(*keys).orderBy("_pid")  # a row for each partition that a key lies in
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = ordered.groupBy(*keys, "_pid").agg(F.sum("_c").alias("_sum")) \
        .select(*keys, "_pid", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"),
                F.sum("_sum").over(whole).alias("_n"))
    inside = Window.partitionBy(*keys, "_pid").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    return null_safe_match(ordered.withColumn("_in", F.sum("_c").over(inside)), offsets, ["_pid"], keys) \
        .withColumn("_upto", F.col("_before") + F.col("_in"))


def _around(summed: DataFrame, keys: list[str], probs: list[float]) -> DataFrame:
    """The rows that hold the two ranks around each quantile, with prob, _pos
    (place from 0), _lo and _hi (ranks from 1)."""
    place = lambda p: (F.col("_n") - 1) * F.lit(p)
    targets = F.array(*[F.struct(F.lit(p).alias("prob"), place(p).alias("pos"), (F.floor(place(p)) + 1).alias("lo"),
                                 (F.ceil(place(p)) + 1).alias("hi")) for p in probs])
    hit = F.filter(targets, lambda t: (F.col("_upto") >= t["lo"]) & (F.col("_upto") - F.col("_c") < t["hi"]))
    return summed.select(*keys, "_v", "_between", F.explode(hit).alias("_t")) \
        .select(*keys, "_v", "_between", F.col("_t.prob").alias("prob"), F.col("_t.pos").alias("_pos"),
                F.col("_t.lo").alias("_lo"), F.col("_t.hi").alias("_hi"))
