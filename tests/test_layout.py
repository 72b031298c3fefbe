"""Interleaved layout: file statistics that serve filters on either column."""
import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from domus.sinks import writers as w
from domus.sinks.layout import with_curve_place, write_interleaved
from domus.sources.tables import listings_from_tables

SF = "/root/testdata/sf0.01"


def spans(path):
    """Per file: least and greatest value of each column."""
    out = []
    for f in glob.glob(f"{path}/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        cols = {}
        for g in range(meta.num_row_groups):
            for c in range(meta.num_columns):
                col = meta.row_group(g).column(c)
                if col.statistics is not None and col.statistics.has_min_max:
                    a, b = cols.get(col.path_in_schema, (col.statistics.min, col.statistics.max))
                    cols[col.path_in_schema] = (min(a, col.statistics.min), max(b, col.statistics.max))
        out.append((meta.num_rows, cols))
    return out


def share(files, column, values):
    """Mean share of the files that a filter on one value must read."""
    touched = [sum(c[column][0] <= v <= c[column][1] for _, c in files if column in c) for v in values]
    return sum(touched) / len(touched) / len(files)


def test_both_filters_touch_few_files(spark, tmpdir_path):
    lst = listings_from_tables(spark, SF)
    n = write_interleaved(lst, f"{tmpdir_path}/z", files=64)
    back = spark.read.parquet(f"{tmpdir_path}/z")
    assert n == lst.count() == back.count()
    assert not lst.exceptAll(back).limit(1).count()
    files = spans(f"{tmpdir_path}/z")
    assert max(r for r, _ in files) < 3 * n / len(files)
    some = lst.orderBy(F.xxhash64("listing_id")).limit(50).collect()
    shares = {c: share(files, c, [r[c] for r in some if r[c] is not None]) for c in ("brokered_by", "zip_code")}
    assert all(x < 0.35 for x in shares.values()), shares
    w.import_wide(lst.repartition(64), f"{tmpdir_path}/c", max_records_per_file=n // 64)
    clustered = spans(f"{tmpdir_path}/c")
    assert share(clustered, "brokered_by", [r["brokered_by"] for r in some if r["brokered_by"] is not None]) > 0.9


def test_place_with_nulls_ties_and_one_value(spark, tmpdir_path):
    rows = [(i, 5.0, None if i % 3 == 0 else float("nan") if i % 3 == 1 else i % 7 + 0.0, "x") for i in range(90)]
    df = spark.createDataFrame(rows, "listing_id long, brokered_by double, zip_code double, files string")
    placed = with_curve_place(df, ["brokered_by", "zip_code"], bits=3)
    by_zip = {r["zip_code"]: r["_place"] for r in placed.where("zip_code < 100").collect()}
    assert len(set(by_zip.values())) > 1
    last = {r["_place"] for r in placed.where("zip_code is null or isnan(zip_code)").collect()}
    assert len(last) == 1 and min(last) > max(by_zip.values())
    assert write_interleaved(df, f"{tmpdir_path}/t", files=4) == 90
    assert write_interleaved(df.limit(0), f"{tmpdir_path}/e", files=4) == 0
    with pytest.raises(ValueError, match="bits"):
        with_curve_place(df, ["zip_code"], bits=20)
