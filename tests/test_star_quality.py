"""Star layout round trip, joins, and data-quality checks."""
import datetime as dt

from domus.operators import quality as qa
from domus.operators import star as st
from domus.operators.joins import bounded_broadcast, first_per_group, null_safe_match
from domus.operators.mutate import add_column_if_missing, drop_column_if_exists, insert_if_absent, upsert
from tests.fixtures import wide


def test_star_round_trip(spark):
    lst = wide(spark)
    star = st.star_tables(lst)
    back = st.star_to_wide(star)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, lst.select(*back.columns).collect()))
    assert all(r["n_orphans"] == 0 for r in qa.foreign_key_report(star).collect())
    # one city name in two states gives two city ids
    assert star["cities"].where("lower(city_name) = 'alpha'").count() == 3
    assert qa.check_unique(star["states"], ["state_name"]).count() == 0


def test_orphans_and_status(spark):
    lst = wide(spark)
    star = st.star_tables(lst)
    stray = spark.createDataFrame([(99, 1.0, 10001, 123)], "listing_id long, street double, zip_code int, city_id long")
    orphans = qa.check_orphans(star["addresses"].unionByName(stray), star["listings"], ["listing_id"])
    assert [r["listing_id"] for r in orphans.collect()] == [99]
    bad = lst.unionByName(lst.limit(1).selectExpr("100L as listing_id", *[c for c in lst.columns if c not in ("listing_id", "status")], "'pending' as status").select(*lst.columns))
    assert [(r["status"], r["n_rows"]) for r in qa.check_status(bad).collect()] == [("pending", 1)]
    nn = {r["column_name"]: r["n_null"] for r in qa.check_not_null(lst, ["price", "bed"]).collect()}
    assert nn == {"price": 1, "bed": 2}


def test_first_per_group_nulls_last(spark):
    df = spark.createDataFrame([(1, None, 5), (1, 2.0, 9), (1, 2.0, 3), (2, None, 1)], "k int, a double, b int")
    got = {r["k"]: (r["a"], r["b"]) for r in first_per_group(df, ["k"], ["a", "b"]).collect()}
    assert got == {1: (2.0, 3), 2: (None, 1)}


def test_null_safe_match(spark):
    d = dt.date(2020, 1, 1)
    left = spark.createDataFrame([(1, "a", d), (2, "a", None), (3, "b", None)], "id int, k string, d date")
    right = spark.createDataFrame([("a", d, 10), ("a", None, 20)], "k string, d date, v int")
    got = sorted((r["id"], r["v"]) for r in null_safe_match(left, right, ["k"], ["d"]).collect())
    assert got == [(1, 10), (2, 20)]


def test_bounded_broadcast(spark):
    small = spark.range(5)
    assert "broadcast" in str(small.join(bounded_broadcast(small, 10), "id")._jdf.queryExecution().logical()).lower()
    big = spark.range(50)
    assert bounded_broadcast(big, 10) is big


def test_mutations(spark):
    lst = wide(spark)
    old = lst.where("listing_id <= 4")
    new = lst.where("listing_id >= 3").selectExpr(*[c if c != "price" else "1.0 as price" for c in lst.columns])
    ins = {r["listing_id"]: r["price"] for r in insert_if_absent(old, new, ["listing_id"]).collect()}
    assert sorted(ins) == [1, 2, 3, 4, 5, 6, 7] and ins[3] == 100.0 and ins[5] == 1.0
    ups = {r["listing_id"]: r["price"] for r in upsert(old, new, ["listing_id"]).collect()}
    assert sorted(ups) == [1, 2, 3, 4, 5, 6, 7] and ups[3] == 1.0 and ups[1] == 100.0
    # idempotence
    twice = upsert(upsert(old, new, ["listing_id"]), new, ["listing_id"])
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, upsert(old, new, ["listing_id"]).collect()))
    added = add_column_if_missing(lst, "solar_panels", "boolean")
    assert added.schema["solar_panels"].dataType.simpleString() == "boolean"
    assert add_column_if_missing(added, "solar_panels", "boolean") is added
    assert "bath" not in drop_column_if_exists(lst, "bath").columns
