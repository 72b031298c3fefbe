"""Distributed rank / top-n / quantiles equal the single-task built-ins on skewed keys."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from domus.operators.ranking import exact_quantiles, rank_within_groups, top_n_per_group


def skewed(spark):
    # key 0 holds a third of the rows; a null key is a group too
    return spark.range(0, 6000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).when(F.col("id") % 97 == 1, F.lit(None))
        .otherwise(F.col("id") % 20).alias("k"),
        F.col("id"), (F.col("id") * 7919 % 500).cast("double").alias("v"))


def rows(df):
    return sorted(map(tuple, df.select(F.coalesce("k", F.lit(-1)), "id", "r").collect()))


def test_rank_equals_row_number(spark):
    df = skewed(spark)
    got = rank_within_groups(df, ["k"], ["v", "id"], "r", partitions=7)
    ref = df.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("v", "id")))
    assert rows(got) == rows(ref)


def test_top_n_methods_agree(spark):
    df = skewed(spark)
    a = top_n_per_group(df, ["k"], ["v", "id"], 4, "r", method="range")
    b = top_n_per_group(df, ["k"], ["v", "id"], 4, "r", method="window")
    assert rows(a) == rows(b)


def test_exact_quantiles_match_percentile(spark):
    df = skewed(spark)
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {(r["k"], r["prob"]): r["value"] for r in exact_quantiles(df, ["k"], "v", probs, 5).collect()}
    ref = df.groupBy("k").agg(F.percentile("v", F.array(*[F.lit(p) for p in probs])).alias("q")).collect()
    for r in ref:
        for p, x in zip(probs, r["q"]):
            assert abs(got[(r["k"], p)] - x) < 1e-9
    assert len(got) == len(ref) * len(probs)


def test_batch_ids_dense_and_unique(spark):
    from domus.functions.ids import LOW_BITS, with_batch_ids
    df = spark.range(0, 5000, numPartitions=7).select((F.col("id") * 3).alias("x"))
    out = with_batch_ids(df, 5, "rid").collect()
    ids = sorted(r["rid"] for r in out)
    assert ids == [(5 << LOW_BITS) + i for i in range(5000)]


def test_quantiles_of_one_common_value(spark):
    """One value is 90 % of a group: it is one row of the ordered counts."""
    df = spark.range(10000).select(F.lit(1).alias("k"), F.when(F.col("id") % 10 < 9, 5.0).otherwise(F.col("id") * 1.0).alias("v"))
    probs = [0.0, 0.25, 0.5, 0.95, 1.0]
    got = {r["prob"]: r["value"] for r in exact_quantiles(df, ["k"], "v", probs, 4).collect()}
    ref = df.agg(F.percentile("v", F.array(*[F.lit(p) for p in probs])).alias("q")).first()["q"]
    assert all(abs(got[p] - x) < 1e-9 for p, x in zip(probs, ref))


def test_quantiles_of_narrowed_groups(spark):
    """Large keys keep only the values inside the brackets, in a window or range-partitioned."""
    v = F.when(F.col("id") % 3 == 0, F.rand(7)).when(F.col("id") % 3 == 1, -F.exp(F.rand(8) * 9)).otherwise(F.lit(2.5))
    df = spark.range(30000).select(F.when(F.col("id") % 10 > 0, (F.col("id") % 4 == 0).cast("int")).alias("k"), v.alias("v"))
    probs = [0.0, 0.002, 0.25, 0.5, 0.75, 0.9, 1.0]
    ref = {r["k"]: r["q"] for r in df.groupBy("k").agg(F.percentile("v", F.array(*[F.lit(p) for p in probs])).alias("q")).collect()}
    for window_rows in (20000, 3000, 50):
        got = {(r["k"], r["prob"]): r["value"] for r in exact_quantiles(df, ["k"], "v", probs, 4, window_rows).collect()}
        assert len(got) == 3 * len(probs)
        assert all(abs(got[(k, p)] - x) < 1e-9 for k, q in ref.items() for p, x in zip(probs, q))


def test_quantiles_outside_their_brackets_are_counted_whole(spark, monkeypatch):
    """Brackets that miss the quantiles cost a full count, not a wrong result."""
    from domus.operators import ranking
    df = spark.range(5000).select((F.col("id") * 1.0).alias("v"))
    kind = F.percentile_approx
    monkeypatch.setattr(ranking.F, "percentile_approx", lambda c, near, n: kind(c, [0.01] * len(near), n))
    got = {r["prob"]: r["value"] for r in exact_quantiles(df, [], "v", [0.25, 0.5], 4, 100).collect()}
    assert got == {0.25: 1249.75, 0.5: 2499.5}


def test_quantiles_without_values(spark):
    df = spark.createDataFrame([("a", None), ("b", 3.0), (None, 1.0), (None, 2.0)], "k string, v double")
    got = {(r["k"], r["value"]) for r in exact_quantiles(df, ["k"], "v", [0.5]).collect()}
    assert got == {("b", 3.0), (None, 1.5)}
    assert exact_quantiles(df.limit(0), ["k"], "v", [0.5]).count() == 0
