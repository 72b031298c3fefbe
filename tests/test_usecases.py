"""Use-case semantics on a literal frame (the decisions D1-D23 of the survey)."""
import pytest
from pyspark.sql import functions as F

from domus.operators import usecases as uc
from tests.fixtures import wide


def ids(df):
    return [r["listing_id"] for r in df.collect()]


def test_uc1_count_includes_all_listings_and_cap_is_strict(spark):
    lst = wide(spark)
    # (Alpha, X) has 4 listings; price < 250000 drops id 4 (null price) only
    out = uc.uc1_filter_properties(lst, min_listings=3, max_price=250000.0)
    assert ids(out) == [2, 1, 3]  # ordered by city, state, price, id
    # price cap strict: 250000.00 is excluded
    out2 = uc.uc1_filter_properties(lst, min_listings=1, max_price=250000.0)
    assert 6 not in ids(out2)
    # count does not apply the price filter: with cap 60 only id 2 remains, city still qualifies
    assert ids(uc.uc1_filter_properties(lst, 3, 60.0)) == [2]


def test_uc1_param_checks(spark):
    with pytest.raises(ValueError):
        uc.uc1_filter_properties(wide(spark), min_listings=-1)
    with pytest.raises(ValueError):
        uc.uc1_filter_properties(wide(spark), max_price=-5.0)


def test_uc2_updates_first_n_of_broker_half_up(spark):
    lst = wide(spark)
    out = uc.uc2_update_prices(lst, broker_id="7.00", percent_delta=0.05, limit=3)
    rows = {r["listing_id"]: r for r in out.collect()}
    assert out.where("updated").count() == 3
    assert [i for i, r in sorted(rows.items()) if r["updated"]] == [1, 2, 3]
    assert rows[1]["price"] == 105.0
    assert rows[7]["price"] == 100.10 and not rows[7]["updated"]  # 4th listing of broker 7 untouched
    # half-up in exact decimal arithmetic: 100.10 * 1.05 = 105.105 -> 105.11
    out7 = uc.uc2_update_prices(lst, broker_id="7", percent_delta=0.05, limit=4)
    assert {r["listing_id"]: r["price"] for r in out7.collect()}[7] == 105.11
    assert out.count() == lst.count()


def test_uc2_param_checks(spark):
    lst = wide(spark)
    with pytest.raises(ValueError):
        uc.uc2_update_prices(lst, percent_delta=-1.0)
    with pytest.raises(ValueError):
        uc.uc2_update_prices(lst, limit=0)
    with pytest.raises(ValueError):
        uc.uc2_update_prices(lst, broker_id="abc")


def test_uc2_null_price_option(spark):
    lst = wide(spark)
    out = uc.uc2_update_prices(lst, broker_id="8", percent_delta=0.1, limit=1, skip_null_price=True)
    upd = [r["listing_id"] for r in out.where("updated").collect()]
    assert upd == [5]  # id 4 has a null price and is skipped
    out2 = uc.uc2_update_prices(lst, broker_id="8", percent_delta=0.1, limit=1)
    assert [r["listing_id"] for r in out2.where("updated").collect()] == [4]


def test_uc3_is_reproducible(spark):
    lst = wide(spark)
    a = [r["solar_panels"] for r in uc.uc3_add_solar_panels(lst).orderBy("listing_id").collect()]
    b = [r["solar_panels"] for r in uc.uc3_add_solar_panels(lst).orderBy("listing_id").collect()]
    assert a == b and set(a) <= {True, False}
    again = uc.uc3_add_solar_panels(uc.uc3_add_solar_panels(lst))
    assert again.columns.count("solar_panels") == 1


def test_uc4_below_threshold_strict_and_guards(spark):
    lst = wide(spark)
    # zip 10001 eligible: ids 1 (10/m2) and 2 (5/m2); avg 7.5; threshold 6.75 -> id 2
    out = uc.uc4_below_threshold(lst, postal_code="10001.00", below_avg_pct=0.10)
    rows = out.collect()
    assert [r["listing_id"] for r in rows] == [2]
    assert rows[0]["price_per_sqm"] == 5.0
    assert uc.uc4_below_threshold(lst, "99999", 0.1).count() == 0  # unknown zip -> empty
    with pytest.raises(ValueError):
        uc.uc4_below_threshold(lst, "10001", 1.0)


def test_uc4_sorted_by_city_case_insensitive(spark):
    lst = wide(spark)
    out = uc.uc4_sorted_by_city(lst, city="  ALPHA ")
    assert ids(out) == [2, 1, 3, 6]  # price > 0 only; cheapest first, id breaks ties
    assert ids(uc.uc4_sorted_by_city(lst, city="alpha", state="y")) == [6]
    with pytest.raises(ValueError):
        uc.uc4_sorted_by_city(lst, city="  ")


def test_uc5_drops_cities_without_eligible_rows(spark):
    lst = wide(spark)
    rows = {r["city_state"]: r["avg_price_per_sqm"] for r in uc.uc5_avg_price_per_city(lst).collect()}
    assert rows == {"Alpha, X": 7.5, "alpha, Y": 50000.0, "Beta, X": 10.01}


def test_avg_if_keeps_groups_with_null(spark):
    rows = {(r["city"], r["state"]): r["avg_price_per_sqm"] for r in uc.avg_if(wide(spark)).collect()}
    assert rows[("Alpha", "Y")] is None  # only a zero price there
    assert rows[("Alpha", "X")] == 7.5


def test_uc6_strict_bounds(spark):
    out = uc.uc6_filter_by_bedrooms_and_size(wide(spark), min_bedrooms=2, max_size=150.0)
    assert ids(out) == [1, 4]


def test_top_n_per_broker(spark):
    out = uc.top_n_per_broker(wide(spark), 2)
    got = sorted((r["brokered_by"], r["listing_id"], r["rank_in_broker"]) for r in out.collect())
    assert got == [(7, 1, 1), (7, 2, 2), (8, 4, 1), (8, 5, 2)]


def test_division_guard_under_ansi(spark):
    from domus.functions.measures import price_per_sqm
    vals = [r[0] for r in wide(spark).select(price_per_sqm()).collect()]
    assert None in vals  # lot 0 -> NULL, no ANSI divide-by-zero error


def test_validate_option_raises_on_unknown_keys(spark):
    lst = wide(spark)
    with pytest.raises(ValueError):
        uc.uc2_update_prices(lst, broker_id="999", validate=True)
    with pytest.raises(ValueError):
        uc.uc4_below_threshold(lst, postal_code="99999", validate=True)
    with pytest.raises(ValueError):
        uc.uc4_sorted_by_city(lst, city="Nowhere", validate=True)
    assert uc.uc4_sorted_by_city(lst, city="Nowhere").count() == 0  # default: empty result
