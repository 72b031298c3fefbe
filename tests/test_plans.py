"""Plan-shape assertions: no Python in the hot path, no cartesian products,
filters and column pruning reach the Parquet scan, bounded window top-k."""
import re

import pytest

import __spark_entry__ as E
from domus.operators import usecases as uc

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def bracket_groups(line: str) -> int:
    """Number of top-level [...] groups after the operator name."""
    depth, groups = 0, 0
    for ch in line:
        if ch == "[":
            if depth == 0:
                groups += 1
            depth += 1
        elif ch == "]":
            depth -= 1
    return groups


def unpartitioned_windows(p: str) -> list[str]:
    """Window operators printed as ``Window [exprs], [order]`` (no partition spec)."""
    return [ln for ln in p.splitlines()
            if re.search(r"(^|[ +\-:*])Window \[", ln) and bracket_groups(ln.split("Window ", 1)[1]) < 3]


def test_window_detector(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    df = spark.range(10).withColumn("k", F.col("id") % 2)
    bad = plan(df.withColumn("r", F.row_number().over(Window.orderBy("id"))))
    good = plan(df.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("id"))))
    assert unpartitioned_windows(bad) and not unpartitioned_windows(good)


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_no_python_udf_and_no_cartesian(spark, name):
    p = plan(E.queries()[name](spark, SF))
    assert "PythonUDF" not in p and "BatchEvalPython" not in p and "ArrowEvalPython" not in p
    assert "CartesianProduct" not in p
    assert "BroadcastNestedLoopJoin" not in p
    # no window without a partition spec (it would put every row in one task)
    assert not unpartitioned_windows(p)


def test_sql_form_plans_as_semi_join(spark):
    p = plan(E.queries()["uc1_sql"](spark, SF))
    assert "LeftSemi" in p


def test_pushdown_and_pruning_on_parquet(spark, tmpdir_path):
    from domus.sources.tables import listings_from_tables
    listings_from_tables(spark, SF).write.parquet(f"{tmpdir_path}/wide")
    t = spark.read.parquet(f"{tmpdir_path}/wide")
    p = plan(uc.uc6_filter_by_bedrooms_and_size(t, 2, 150.0))
    assert "PushedFilters: [IsNotNull(bed), IsNotNull(house_size_sqm), GreaterThan(bed,2), LessThan(house_size_sqm,150.0)]" in p
    p5 = plan(uc.uc5_avg_price_per_city(t))
    assert "ReadSchema: struct<price:double,lot_size_sqm:double,city:string,state:string>" in p5


def test_top_n_uses_window_group_limit(spark):
    from domus.sources.tables import listings_from_tables
    p = plan(uc.top_n_per_broker(listings_from_tables(spark, SF), 3))
    assert "WindowGroupLimit" in p


def test_uc2_broadcasts_only_the_topk(spark):
    from domus.sources.tables import listings_from_tables
    lst = listings_from_tables(spark, SF)
    p = E.queries()["uc2_update_prices"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "GlobalLimit 10" in p
