"""Structured Streaming: incremental import and windowed telemetry."""
import datetime as dt
import os

import pytest

from pyspark.sql import functions as F

from domus.functions.ids import LOW_BITS
from domus.operators import cleaning as cl
from domus.schema import LISTING
from domus.sources.derived import clean_csv_text
from domus.streaming import ingest, telemetry
from tests.fixtures import wide

SF = "/root/testdata/sf0.001"


def test_import_stream_batches_and_restart(spark, tmpdir_path):
    src, target, ckpt = (f"{tmpdir_path}/{n}" for n in ("src", "target", "ckpt"))
    text = clean_csv_text(spark, SF)
    valid, _ = cl.parse_listings(text)
    n_valid = valid.count()
    text.drop("src_pos").repartition(3).write.option("header", True).csv(src)
    q = ingest.import_stream(spark, src, target, ckpt, max_files_per_trigger=1)
    q.awaitTermination()
    counts = ingest.batch_counts(spark, ckpt).collect()
    assert len(counts) == 3
    assert sum(r["imported"] for r in counts) == n_valid
    assert spark.read.parquet(target).count() == n_valid
    # restart on the same checkpoint: no file is consumed twice
    q2 = ingest.import_stream(spark, src, target, ckpt, max_files_per_trigger=1)
    q2.awaitTermination()
    assert spark.read.parquet(target).count() == n_valid
    assert spark.read.parquet(target).select("listing_id").distinct().count() == n_valid


def test_import_stream_skip_keeps_one_row_per_natural_key(spark, tmpdir_path):
    from domus.plans.engine import NATURAL_KEY
    src, target, ckpt = (f"{tmpdir_path}/{n}" for n in ("src", "target", "ckpt"))
    text = clean_csv_text(spark, SF)
    valid, _ = cl.parse_listings(text)
    keys = cl.to_wide_listing(valid).select(*NATURAL_KEY).distinct().count()
    text.drop("src_pos").repartition(3).write.option("header", True).csv(src)
    ingest.import_stream(spark, src, target, ckpt, on_duplicate="skip").awaitTermination()
    out = spark.read.parquet(target)
    assert out.count() == keys == out.select(*NATURAL_KEY).distinct().count()


CSV = "brokered_by,status,price,bed,bath,lot_size_sqm,street,city,state,zip_code,house_size_sqm,prev_sold_date"


def _deliver(folder, name, *rows):
    """A file of cleaned listings: (broker, price, bed, date) each."""
    os.makedirs(folder, exist_ok=True)
    lines = [f"{b},sold,{p},{bed},1,10.0,5.0,Alpha,X,10001,90.0,{d}" for b, p, bed, d in rows]
    with open(f"{folder}/{name}.csv", "w") as f:
        f.write("\n".join([CSV, *lines]) + "\n")


def _skip(spark, base):
    q = ingest.import_stream(spark, f"{base}/src", f"{base}/target", f"{base}/ckpt", on_duplicate="skip")
    q.awaitTermination()
    rows = spark.read.schema(LISTING).parquet(f"{base}/target").collect()
    return q, sorted((r["brokered_by"], r["price"], r["bed"], r["prev_sold_date"]) for r in rows)


def test_import_stream_skip_remembers_keys_over_restarts(spark, tmpdir_path):
    src, day = f"{tmpdir_path}/src", dt.date(2020, 1, 2)
    _deliver(src, "z", (1, 10, 1, day), (1, 10, 2, day), (2, 10, 3, ""), (2, "nan", 3, ""))
    _, got = _skip(spark, tmpdir_path)
    assert got == [(1, 10.0, 1, day), (2, 10.0, 3, None)]  # the first line of each key, NULL dates equal
    # a name that sorts before: what was read first stays
    _deliver(src, "a", (1, 10, 7, day), (2, 10, 8, ""), (2, 11, 9, ""), (1, 10, 9, ""))
    q, got = _skip(spark, tmpdir_path)
    after = [(1, 10.0, 1, day), (1, 10.0, 9, None), (2, 10.0, 3, None), (2, 11.0, 9, None)]
    assert sorted(map(str, got)) == sorted(map(str, after))
    state = q.lastProgress["stateOperators"][0]
    assert state["numRowsTotal"] == 4 and q.lastProgress["numInputRows"] == 4  # its own rows, not those imported before
    plan = q._jsq.explainInternal(False)
    assert "StateStoreRestore" in plan and "/target" not in plan and "SortAggregate" not in plan
    counts = sorted(map(tuple, ingest.batch_counts(spark, f"{tmpdir_path}/ckpt").collect()))
    assert counts == [(0, 2, 1, 1), (1, 2, 0, 2)]
    _, again = _skip(spark, tmpdir_path)  # nothing new
    assert again == got


def test_keep_first_stream_ignores_rows_that_are_written_again(spark, tmpdir_path):
    """An import batch that failed while it was published is written again, in new files."""
    _deliver(f"{tmpdir_path}/src", "one", (1, 10, 1, ""), (2, 10, 2, ""))
    _, got = _skip(spark, tmpdir_path)
    rows = f"{tmpdir_path}/ckpt_rows"
    spark.createDataFrame(spark.read.schema(LISTING).parquet(f"{rows}/batch=0").collect(), LISTING) \
        .write.mode("overwrite").parquet(f"{rows}/batch=0")
    q, again = _skip(spark, tmpdir_path)
    assert q.lastProgress["numInputRows"] == 2 and again == got


def test_rows_with_ids_reads_the_batches_of_the_ids(spark, tmpdir_path):
    rows = wide(spark).withColumn("batch", (F.col("listing_id") % 3).cast("int")) \
        .withColumn("listing_id", F.shiftleft((F.col("batch") + 1).cast("long"), LOW_BITS) + F.col("listing_id"))
    rows.write.partitionBy("batch").parquet(tmpdir_path + "/rows")
    ids = rows.where("batch = 1").select("listing_id").limit(1)
    out = ingest.rows_with_ids(spark, tmpdir_path + "/rows", ids)
    assert out.count() == 1 and all("batch=1" in f for f in out.inputFiles() if "/rows/" in f)
    assert ingest.rows_with_ids(spark, tmpdir_path + "/rows", ids.where("false")).count() == 0


def test_import_stream_refuses_a_target_of_another_checkpoint(spark, tmpdir_path):
    _deliver(f"{tmpdir_path}/src", "one", (1, 10, 1, ""))
    for how in ("append", "skip"):
        target = f"{tmpdir_path}/{how}"
        ingest.import_stream(spark, f"{tmpdir_path}/src", target, f"{target}-c1", on_duplicate=how).awaitTermination()
        with pytest.raises(ValueError, match="another checkpoint"):
            ingest.import_stream(spark, f"{tmpdir_path}/src", target, f"{target}-c2", on_duplicate=how)


def test_telemetry_stream_is_complete_in_any_file_order(spark, tmpdir_path):
    """Three files, newest first, and a folder of part files give the batch result."""
    ev = spark.read.parquet(f"{SF}/events.parquet")
    cuts = [c[0] for c in ev.selectExpr("percentile(event_id, array(0.33, 0.66)) q").select(F.explode("q")).collect()]
    folder = f"{tmpdir_path}/events.parquet"
    parts = [ev.where(F.col("event_id") > cuts[1]), ev.where(F.col("event_id").between(cuts[0], cuts[1])),
             ev.where(F.col("event_id") < cuts[0])]
    for i, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(folder)
        telemetry.telemetry_stream(spark, folder, f"{tmpdir_path}/out", f"{tmpdir_path}/ckpt").awaitTermination()
    telemetry.telemetry_stream(spark, f"{SF}/events.parquet", f"{tmpdir_path}/out1", f"{tmpdir_path}/ckpt1").awaitTermination()
    got, ref = (sorted(map(tuple, telemetry.latest_windows(spark, f"{tmpdir_path}/{o}").collect())) for o in ("out", "out1"))
    assert len(got) == len(ref) and sum(r[-1] for r in got) == ev.count()
    for a, b in zip(got, ref):
        assert a[:3] == b[:3] and a[-1] == b[-1]
        assert all(abs(x - y) < 0.011 for x, y in zip(a[3:-1], b[3:-1]))


def test_telemetry_stream_counts_late_rows(spark, tmpdir_path):
    src, out, ckpt = (f"{tmpdir_path}/{n}" for n in ("events", "out", "ckpt"))
    ts = dt.datetime
    b1 = [(1, ts(2024, 1, 1, 10), 1, "a", 1.0, None), (2, ts(2024, 1, 1, 11), 2, "a", 3.0, None)]
    b2 = [(3, ts(2024, 1, 3, 10), 3, "a", 5.0, None)]
    b3 = [(5, ts(2024, 1, 1, 13), 5, "a", 1000.0, None)]  # long after its day: still counted
    for rows in (b1, b2, b3):
        spark.createDataFrame(rows, telemetry.EVENTS).coalesce(1).write.mode("append").parquet(src)
        telemetry.telemetry_stream(spark, src, out, ckpt, window="1 day").awaitTermination()
    res = {r["window_start"].day: r for r in telemetry.latest_windows(spark, out).collect()}
    assert res[1]["samples"] == 3 and res[1]["peak_cpu"] == 1000.0
    assert res[3]["samples"] == 1


def test_telemetry_partials_are_merged_by_level(spark, tmpdir_path):
    """200 epochs are read from a few runs, replays change nothing, and sums are whole."""
    out, fan = f"{tmpdir_path}/levels", 8
    ts = dt.datetime
    rows = [("a", ts(2024, 1, 1, 10), 1.0, 4.0, 8), ("b", ts(2024, 1, 2, 10), 3.0, None, 9)]
    samples = spark.createDataFrame(rows, "system string, ts timestamp, cpu_percent double, mem_mb double, blkio_bytes long")
    partials = telemetry.windowed_partials(samples.coalesce(1)).coalesce(1)
    base = f"{tmpdir_path}/base"
    partials.write.parquet(base)
    one = spark.read.parquet(base)
    for epoch in range(200):
        telemetry.add_partials(one, out, epoch, fan)
        if epoch in (6, 7, 63, 64, 127):  # the batch is run again after a failure
            telemetry.add_partials(one, out, epoch, fan)
            got = {r["system"]: r["samples"] for r in telemetry.latest_windows(spark, out, fan).collect()}
            assert got == {"a": epoch + 1, "b": epoch + 1}
    runs = telemetry.current_runs(spark, out, fan)
    assert len(runs) == 3 + 1  # 200 = 3 * 64 + 1 * 8
    assert len(spark.read.parquet(*runs).inputFiles()) <= 24
    got = {r["system"]: (r["avg_cpu"], r["avg_mem"], r["samples"]) for r in telemetry.latest_windows(spark, out, fan).collect()}
    assert got == {"a": (1.0, 4.0, 200), "b": (3.0, None, 200)}
    # merged runs are kept until the run above theirs is complete: 24 of level 1 under level 2, 8 of level 0 under level 1
    left = {level: len(found) for level, found in telemetry._complete_runs(spark, out).items()}
    assert left == {2: 3, 1: 24 + 1, 0: 8}


def test_telemetry_stream_refuses_a_folder_of_another_checkpoint(spark, tmpdir_path):
    out = f"{tmpdir_path}/out"
    telemetry.telemetry_stream(spark, f"{SF}/events.parquet", out, f"{tmpdir_path}/c1").awaitTermination()
    with pytest.raises(ValueError, match="another checkpoint"):
        telemetry.telemetry_stream(spark, f"{SF}/events.parquet", out, f"{tmpdir_path}/c2")


def test_delivery_in_parts_is_read_in_the_order_of_names(spark, tmpdir_path):
    """One micro-batch reads all parts; the first part's listing stays, though the later part is older and larger."""
    src, target, ckpt = (f"{tmpdir_path}/{n}" for n in ("src", "target", "ckpt"))
    _deliver(src, "part-1", *[(7, "10.0", 9, "2020-01-01")] * 2, *[(b, "11.0", 1, "2020-01-01") for b in range(100, 300)])
    _deliver(src, "part-0", (7, "10.0", 2, "2020-01-01"), (8, "10.0", 3, "2020-01-01"))
    ingest.import_stream(spark, src, target, ckpt, max_files_per_trigger=None, on_duplicate="skip").awaitTermination()
    assert len(ingest.batch_counts(spark, ckpt).collect()) == 1
    out = spark.read.parquet(target)
    assert out.count() == 202 and [r.bed for r in out.where("brokered_by = 7").collect()] == [2]
    ids = sorted(r.listing_id for r in spark.read.parquet(f"{ckpt}_rows").collect())
    assert ids == [(1 << LOW_BITS) + i for i in range(204)]
