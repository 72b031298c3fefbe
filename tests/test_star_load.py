"""Incremental load into the star: ids that stay, inserts, updates, quarantine, a load that died."""
import datetime as dt
import glob

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from domus.operators import usecases as uc
from domus.operators.star import listing_details
from domus.plans.engine import ListingsEngine
from domus.schema import LISTING
from domus.sinks.partitioned import change_rows, replace_partitions
from domus.sinks.star_load import Loaded, Star


def rows(*listings):
    """(id, broker, status, price, city, state, zip, bed)"""
    return [(i, b, s, p, 100.0, float(i or 0), c, st, z, bed, None, None, dt.date(2020, 1, 1))
            for i, b, s, p, c, st, z, bed in listings]


def frame(spark, *listings):
    loose = StructType([StructField(f.name, f.dataType, True) for f in LISTING.fields])
    return spark.createDataFrame(rows(*listings), loose).repartition(3)


def test_load_inserts_updates_and_keeps_ids(spark, tmpdir_path):
    star = Star(spark, f"{tmpdir_path}/star", id_range=10)
    first = star.load(frame(spark, (1, 7, "sold", 10.0, "Bern", "B", 3000, 2), (2, 7, None, 20.0, "Ulm", "A", 3001, None),
                            (35, 8, "sold", 30.0, "Bern", "B", 3000, 3)))
    assert first == Loaded(1, 3, 0, 3, 0)
    states = {r.state_name: r.state_id for r in star.tables()["states"].collect()}
    assert states == {"A": 1, "B": 2}
    old = set(glob.glob(f"{tmpdir_path}/star/estate_details/load=1/id_range=0/*.parquet"))
    second = frame(spark, (35, 9, "sold", 99.0, "Bern", "B", 3000, 4), (2, 7, None, 20.0, "Ulm", "A", 3001, 5),
                   (40, 9, "for_sale", 1.0, "Aach", "0", 3002, None), (41, 9, "gone", 1.0, "X", "Y", 3003, 1),
                   (None, 9, "sold", 1.0, "X", "Y", 3003, 1), (42, None, "sold", 1.0, "X", "Y", 3003, 1))
    assert star.load(second) == Loaded(2, 6, 3, 1, 1)  # 35 has other beds; 2 had no details
    t = star.tables()
    assert {r.state_name: r.state_id for r in t["states"].collect()} == {**states, "0": 3}
    assert {(r.city_name, r.city_id, r.state_id) for r in t["cities"].collect()} == {("Bern", 1, 2), ("Ulm", 2, 1), ("Aach", 3, 3)}
    got = {r.listing_id: (r.brokered_by, r.price, r.bed, r.city) for r in listing_details(t).collect()}
    assert got == {1: (7, 10.0, 2, "Bern"), 2: (7, 20.0, 5, "Ulm"), 35: (8, 30.0, 4, "Bern"), 40: (9, 1.0, None, "Aach")}
    assert {r.brokered_by for r in t["brokers"].collect()} == {7, 8, 9}
    bad = {(r.listing_id, r.reasons, r.load) for r in star.quarantine().collect()}
    assert bad == {(41, "status", 2), (None, "listing_id", 2), (42, "brokered_by", 2)}
    # listing 35 lies in another folder than 1: that one was not rewritten
    assert old == set(glob.glob(f"{tmpdir_path}/star/estate_details/load=1/id_range=0/*.parquet"))
    before = {n: sorted(map(tuple, df.collect()), key=str) for n, df in t.items()}
    assert star.load(second) == Loaded(3, 6, 3, 0, 0)
    assert {n: sorted(map(tuple, df.collect()), key=str) for n, df in star.tables().items()} == before


def test_a_load_that_died_is_run_again(spark, tmpdir_path, monkeypatch):
    star = Star(spark, f"{tmpdir_path}/star")
    star.load(frame(spark, (1, 7, "sold", 10.0, "Bern", "B", 3000, 2)))
    batch = frame(spark, (1, 7, "sold", 10.0, "Bern", "B", 3000, 3), (2, 8, "sold", 10.0, "Ulm", "C", 3001, 2))
    real = Star._details

    def dies(self, name, *rest):
        if name == "addresses":
            raise RuntimeError("lost")
        return real(self, name, *rest)
    monkeypatch.setattr(Star, "_details", dies)
    with pytest.raises(RuntimeError):
        star.load(batch)
    assert {r.brokered_by for r in star.tables()["brokers"].collect()} == {7}  # nothing new is published
    assert star.last_load() == 1
    monkeypatch.setattr(Star, "_details", real)
    done = star.load(batch)
    assert (done.load, done.new) == (2, 1)
    t = star.tables()
    assert [r.listing_id for r in t["listings"].orderBy("listing_id").collect()] == [1, 2]
    assert {r.listing_id: r.bed for r in t["estate_details"].collect()} == {1: 3, 2: 2}
    assert t["addresses"].count() == 2 and t["land_data"].count() == 2


def test_empty_and_repeating_batches(spark, tmpdir_path):
    star = Star(spark, f"{tmpdir_path}/star")
    assert star.load(spark.createDataFrame([], LISTING)) == Loaded(1, 0, 0, 0, 0)
    one = (5, 7, "sold", 10.0, "Bern", "B", 3000, 2)
    assert star.load(frame(spark, one, one, (5, 7, "sold", 12.0, "Bern", "B", 3000, 2))) == Loaded(2, 3, 0, 1, 0)
    assert [r.price for r in star.tables()["listings"].collect()] == [10.0]


def test_next_ids_are_dense_and_ordered(spark):
    from domus.functions.ids import with_next_ids
    df = spark.createDataFrame([(f"k{i:04d}",) for i in range(500)], "k string").repartition(7)
    got = {r.k: r.n for r in with_next_ids(df, ["k"], "n", 11).collect()}
    assert got == {f"k{i:04d}": 11 + i for i in range(500)}


def test_change_rows_reads_and_writes_touched_partitions_only(spark, tmpdir_path):
    path = f"{tmpdir_path}/t"
    table = spark.range(40).select("id", (F.col("id") * 2).alias("v"), (F.col("id") % 4).alias("a"), F.floor(F.col("id") / 20).alias("b"))
    replace_partitions(table, path, ["a", "b"])
    stored = spark.read.parquet(path).select("id", "v", "a", "b")
    files = set(glob.glob(f"{path}/*/*/*.parquet"))
    n = change_rows(stored, path, stored.where("id in (1, 22)").withColumn("v", F.lit(-1).cast("long")), "id", ["a", "b"])
    assert n == 2
    spark.catalog.refreshByPath(path)
    assert {r.id: r.v for r in spark.read.parquet(path).collect()} == {i: -1 if i in (1, 22) else 2 * i for i in range(40)}
    kept = {f for f in files if "/a=1/b=0/" not in f and "/a=2/b=1/" not in f}
    assert kept < set(glob.glob(f"{path}/*/*/*.parquet")) and len(kept) >= 6


def test_uc4_arguments_reach_both_parts(spark, tmpdir_path):
    wide = frame(spark, (1, 7, "sold", 10.0, "Bern", "B", 3000, 2), (2, 7, "sold", None, "Bern", "B", 3000, 2))
    assert uc.uc4_price_analysis(wide, "3000", 0.1, "bern")["sorted_by_city"].count() == 1
    every = uc.uc4_price_analysis(wide, "3000", 0.1, "bern", require_positive_price=False)["sorted_by_city"].collect()
    assert [r.listing_id for r in every] == [1, 2]  # a null price comes last
    assert uc.uc4_json_rows(wide, "3000", 0.1, "bern", require_positive_price=False).count() == 2
    for args in (("9", 0.1, "bern"), ("3000", 0.1, "nowhere")):
        with pytest.raises(ValueError):
            uc.uc4_price_analysis(wide, *args, validate=True)
    engine = ListingsEngine(spark, f"{tmpdir_path}/e")
    with pytest.raises(ValueError):
        engine.usecase4_price_analysis("3000", 0.1, "bern", validate=True)
    assert engine.usecase4_price_analysis("3000", 0.1, "bern", require_positive_price=False)["sorted_by_city"].count() == 0


def test_batches_read_the_listings_once(spark):
    """Three loads take their rows from one staged projection, not from three joins of the tables."""
    from domus.plans.stored import _star_batches
    for batch in _star_batches(spark, "/root/testdata/sf0.001"):
        assert all("star-listings" in f for f in batch.inputFiles())
