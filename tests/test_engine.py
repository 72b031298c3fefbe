"""The use-case engine over plain partitioned Parquet, end to end on the sf0.001 tables."""
import glob
import json

import pytest
from pyspark.sql import functions as F

from domus.plans.engine import ListingsEngine
from domus.sinks import imports
from domus.sources.derived import clean_csv_text
from domus.sources.files import csv_lines, json_lines, read_lines, with_line_numbers
from tests.test_plans import plan, unpartitioned_windows

SF = "/root/testdata/sf0.001"


def by_id(df):
    return {r.listing_id: r for r in df.collect()}


def export(spark, path, n=None):
    rows = clean_csv_text(spark, SF).drop("src_pos")
    if n:
        rows = rows.where("price <> '' and price <> 'nan' and brokered_by <> '' and city <> '' and status <> ''"
                          " and lot_size_sqm not in ('', 'abc') and zip_code not like '%.0'").limit(n).coalesce(1)
    rows.write.option("header", True).csv(path)
    return path


def test_engine_flow(spark, tmpdir_path):
    csv = export(spark, f"{tmpdir_path}/in")
    text = clean_csv_text(spark, SF)
    eng = ListingsEngine(spark, f"{tmpdir_path}/tbl")
    eng.reset_database()
    assert eng.get_total_count() == 0
    counts = eng.usecase7_bulk_import(csv, batch_size=100)
    per_file = spark.read.parquet(f"{eng.rows_path}/import_no=1/kind=valid").groupBy(F.input_file_name()).count().collect()
    assert max(r["count"] for r in per_file) <= 100
    assert counts["imported"] + counts["rejected"] == text.count()
    assert eng.get_total_count() == counts["imported"] == eng.table().select("listing_id").distinct().count()
    rejects = eng.rejects(1)
    assert rejects.count() == counts["rejected"] and rejects.where("reasons = '' or line < 2").count() == 0
    broker = eng.table().groupBy("brokered_by").count().orderBy("count", ascending=False).first()
    own = lambda: by_id(eng.table().where(f"brokered_by = {broker['brokered_by']}"))
    before, files = own(), set(glob.glob(f"{eng.rows_path}/*/*/*/*.parquet"))
    n = eng.usecase2_update_prices(str(broker["brokered_by"]), 0.05, 3)
    assert n == min(3, broker["count"]) and eng.get_total_count() == counts["imported"]
    after = own()
    assert sorted(i for i in before if before[i].price != after[i].price) == sorted(before)[:n]
    # only the folder of that broker's part was written anew
    now = set(glob.glob(f"{eng.rows_path}/*/*/*/*.parquet"))
    assert {f.split("/")[-2] for f in files - now} == {f"broker_part={broker['brokered_by'] % 16}"}
    first = sorted(before)[0]
    eng.usecase2_update_prices(str(broker["brokered_by"]), 0.05, 1)
    assert own()[first].price == round(round(before[first].price * 1.05 + 1e-9, 2) * 1.05 + 1e-9, 2)
    assert "solar_panels" not in eng.table().columns
    assert eng.usecase3_add_solar_panels() == counts["imported"]
    flags = {i: r.solar_panels for i, r in by_id(eng.table()).items()}
    assert set(flags.values()) == {True, False}
    # a fresh engine on the same folder sees the same table
    assert {i: r.solar_panels for i, r in by_id(ListingsEngine(spark, f"{tmpdir_path}/tbl").table()).items()} == flags
    assert eng.usecase1_filter_properties(1, 1e12).count() == counts["imported"]
    assert eng.usecase4_price_analysis("10000", 0.1, "nation_0")["sorted_by_city"].count() > 0
    assert eng.usecase5_average_price_per_city().count() > 0
    # the same file again: "skip" drops rows present by natural key (those that UC2
    # changed aren't), "append" adds all under new ids
    eng.usecase7_bulk_import(csv, on_duplicate="skip")
    assert eng.get_total_count() == counts["imported"] + n
    assert eng.table().where("solar_panels is null").count() == n  # imported after UC3
    eng.usecase7_bulk_import(csv)
    assert eng.get_total_count() == 2 * counts["imported"] + n == eng.table().select("listing_id").distinct().count()


def test_engine_without_table(spark, tmpdir_path):
    eng = ListingsEngine(spark, f"{tmpdir_path}/empty")
    assert eng.get_total_count() == 0
    assert eng.usecase2_update_prices("7", 0.05, 3) == 0
    assert eng.usecase1_filter_properties(1, 1.0).count() == 0
    with pytest.raises(ValueError):
        eng.usecase2_update_prices("7", -2.0, 3)


def test_an_import_that_died_is_not_seen_and_replaced(spark, tmpdir_path, monkeypatch):
    csv = export(spark, f"{tmpdir_path}/in", 5)
    eng = ListingsEngine(spark, f"{tmpdir_path}/tbl")
    assert eng.usecase7_bulk_import(csv) == {"imported": 5, "rejected": 0}
    real = imports.write_import

    def dies(*a):
        real(*a)
        raise RuntimeError("lost")
    monkeypatch.setattr(imports, "write_import", dies)
    with pytest.raises(RuntimeError):
        eng.usecase7_bulk_import(csv)
    assert eng.get_total_count() == 5 and eng.imports().count() == 1
    monkeypatch.setattr(imports, "write_import", real)
    eng.usecase7_bulk_import(csv)
    assert eng.get_total_count() == 10 == eng.table().select("listing_id").distinct().count()


def test_dataframe_input_and_reset(spark, tmpdir_path):
    eng = ListingsEngine(spark, f"{tmpdir_path}/tbl")
    text = clean_csv_text(spark, SF).drop("src_pos")
    seen = eng.usecase7_bulk_import(text)
    assert seen["imported"] + seen["rejected"] == text.count()
    bad = eng.rejects(1).first()
    assert json.loads(bad.line_text) and bad.reasons
    eng.usecase3_add_solar_panels()
    eng.reset_database()
    assert eng.get_total_count() == 0 and eng.table().columns[-1] == "prev_sold_date"
    assert eng.usecase7_bulk_import(text) == seen


def test_uc2_plan_has_one_scan_and_no_join(spark, tmpdir_path):
    from domus.operators.usecases import uc2_changed_rows
    eng = ListingsEngine(spark, f"{tmpdir_path}/tbl")
    eng.usecase7_bulk_import(export(spark, f"{tmpdir_path}/in", 50))
    plan = uc2_changed_rows(eng._listings(), "7", 0.1, 5)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("FileScan") == 1 and "EqualTo(brokered_by,7)" in plan


def test_import_reads_its_input_once(spark, tmpdir_path):
    rows = imports.parsed_lines(export(spark, f"{tmpdir_path}/in"), 1, spark, 4)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan


def test_lines_over_many_files_and_splits(spark, tmpdir_path):
    """Ids are unique and ascend in a file, line numbers are those of the file, whatever the splits."""
    body = {f"f{i}.csv": [f"{i},{j}" for j in range(200 * i + 1)] for i in range(3)}
    for name, lines in body.items():
        with open(f"{tmpdir_path}/{name}", "w") as f:
            f.write("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500b")
    try:
        lines = read_lines(spark, tmpdir_path, 5).where("src_file like '%.csv'")
        rows = with_line_numbers(lines, lines).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == sum(map(len, body.values())) == len({r.listing_id for r in rows})
    assert len({(r.src_file, r.src_block) for r in rows}) > 4 and {r.listing_id >> 50 for r in rows} == {5}
    for r in rows:
        assert body[r.src_file.rsplit("/", 1)[1]][r.line - 1] == r.line_text
    for bad in (0, 8192):
        with pytest.raises(ValueError):
            read_lines(spark, tmpdir_path, bad)


def test_malformed_csv_and_json_lines(spark, tmpdir_path):
    from pyspark.sql.types import LongType, StringType, StructField, StructType
    two = StructType([StructField("a", StringType()), StructField("b", StringType())])
    text = ["a,b", "1,2", '"x, ""y""",3', "1", "1,2,3", "", '"1,2', ",", "1,2\r"]
    with open(f"{tmpdir_path}/x.csv", "w", newline="") as f:
        f.write("\n".join(text) + "\n")
    got = csv_lines(read_lines(spark, f"{tmpdir_path}/x.csv"), two).orderBy("listing_id").collect()
    assert [(r.skipped, r.malformed) for r in got if not r.skipped] == [(False, m) for m in (False, False, True, True, True, False, False)]
    assert [r.line_text for r in got if r.skipped] == ["a,b", ""]
    assert (got[2].a, got[2].b) == ('x, "y"', "3") and got[-1].b == "2"
    one = StructType([StructField("a", StringType()), StructField("n", LongType())])
    with open(f"{tmpdir_path}/x.jsonl", "w") as f:
        f.write('{"a": "x", "n": 1}\n{"a": "x", "n": "z"}\n{"a": \n\n{}\n')
    got = json_lines(read_lines(spark, f"{tmpdir_path}/x.jsonl"), one).orderBy("listing_id").collect()
    assert [(r.skipped, r.malformed) for r in got if not r.skipped] == [(False, False), (False, True), (False, True), (False, False)]


def test_export_in_parts_is_one_text(spark, tmpdir_path):
    """The broken export is written by several tasks; its lines count through the parts."""
    from domus.plans.stored import _broken_export
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        path = _broken_export(spark, SF)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    text = [open(f).read().splitlines() for f in sorted(glob.glob(f"{path.removeprefix('file:')}/part-*"))]
    assert sum(map(bool, text)) > 1
    whole = [line for part in text for line in part]
    assert whole[0].startswith("brokered_by,") and len(whole) == clean_csv_text(spark, SF).count() + 1
    eng = ListingsEngine(spark, f"{tmpdir_path}/tbl")
    eng.usecase7_bulk_import(path)
    rejects = eng.rejects(1, parts=True).collect()
    assert rejects and all(whole[r.line - 1] == r.line_text for r in rejects)
    assert max(r.line for r in eng.rejects(1).collect()) < max(r.line for r in rejects)


def test_line_numbers_through_many_parts(spark):
    """Parts and blocks are counted in the order of their names, not of the ids, and no task holds all splits."""
    splits = [(f"part-{f:03}", b * 100, (f * 7 + b * 3) % 5 + 1) for f in range(40) for b in range(3)]
    rows, want, line = [], {}, 0
    for i, (name, block, n) in enumerate(splits):
        for k in range(n):
            line += 1
            rows.append(((i * 37 % len(splits)) * 1000 + k, name, block))
            want[rows[-1]] = line
    lines = spark.createDataFrame(rows[::-1], "listing_id long, src_file string, src_block long").repartition(5)
    got = with_line_numbers(lines, lines, parts=True)
    assert not unpartitioned_windows(plan(got))
    assert {(r.listing_id, r.src_file, r.src_block): r.line for r in got.collect()} == want
    assert with_line_numbers(lines.limit(0), lines.limit(0), parts=True).count() == 0
