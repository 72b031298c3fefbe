"""Run-record parsing and telemetry arithmetic edge cases."""
import datetime as dt
import json

from domus.operators import telemetry as tm
from domus.schema import SNAPSHOT
from domus.sources.runs import read_runs


def test_cpu_percent_and_blkio(spark):
    rows = [
        (1.0, 200, 100, 2000, 1000, 2, 1048576, [{"value": 5}, {"value": None}]),  # 100/1000*2*100 = 20
        (2.0, 100, 100, 2000, 1000, 2, 0, []),          # cpu delta 0 -> 0
        (3.0, 200, 100, 1000, 1000, 2, 0, None),        # system delta 0 -> 0
        (4.0, 200, 100, 2000, 1000, None, 0, [{"value": 7}]),  # cpus null -> 1
        (5.0, 200, 100, 2000, 1000, 0, 0, [{"value": 7}]),     # cpus 0 -> 1
    ]
    df = spark.createDataFrame(rows, SNAPSHOT)
    got = df.select(tm.cpu_percent().alias("c"), tm.blkio_total().alias("b")).collect()
    assert [r["c"] for r in got] == [20.0, 0.0, 0.0, 10.0, 10.0]
    assert [r["b"] for r in got] == [5, 0, 0, 7, 7]


def write_runs(path, name, records):
    import os
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/{name}", "w") as f:
        for r in records:
            f.write(json.dumps(r) + "\n")


def test_run_records_from_jsonl(spark, tmpdir_path):
    base = {"index": 1, "run_id": "2031-03-04T05:06:07.080910", "database": "systema", "container": "c",
            "usecase": "usecase7_bulk_import", "status": "Success", "error": None, "execution_time_s": 26.0,
            "avg_cpu_percent": 1.0, "peak_cpu_percent": 2.0, "avg_mem_mb": 3.0, "peak_mem_mb": 4.0,
            "total_blkio_mb": 0.0, "samples": 2, "timestamp_utc": "2031-03-04T05:06:33.111213",
            "raw_samples": [
                {"timestamp": 1.0, "cpu_percent": 10.0, "mem_mb": 100.0, "blkio_bytes": 1048576,
                 "net_rx_bytes": None, "net_tx_bytes": None},
                {"timestamp": 2.0, "cpu_percent": 20.0, "mem_mb": 300.0, "blkio_bytes": 3145728,
                 "net_rx_bytes": 1, "net_tx_bytes": 2}]}
    one = dict(base, index=2, usecase="usecase1_filter_properties", raw_samples=[base["raw_samples"][0]])
    empty = dict(base, index=3, usecase="usecase5_average_price_per_city", raw_samples=[])
    write_runs(tmpdir_path, "systema_04-03-2031_Run1.jsonl", [base, one, empty])
    runs = read_runs(spark, tmpdir_path)
    recs = {r["usecase_number"]: r for r in tm.run_records(runs).collect()}
    r7 = recs[7]
    assert r7["timestamp"] == dt.datetime(2031, 3, 4, 5, 6, 7, 80910)
    assert r7["usecase_name"] == "bulk import" and r7["execution_time_ms"] == 26000
    assert (r7["file_database"], r7["run_date"], r7["run_number"]) == ("systema", dt.date(2031, 3, 4), 1)
    s = {r["index"]: r for r in tm.summarize_samples(runs).collect()}
    assert (s[1]["avg_cpu"], s[1]["peak_cpu"], s[1]["avg_mem"], s[1]["total_blkio_mb"], s[1]["n_samples"]) == \
        (15.0, 20.0, 200.0, 2.0, 2)
    assert s[2]["total_blkio_mb"] == 0.0
    assert (s[3]["avg_cpu"], s[3]["peak_cpu"], s[3]["total_blkio_mb"], s[3]["n_samples"]) == (0.0, 0.0, 0.0, 0)
    flat = tm.explode_samples(runs)
    assert flat.count() == 4  # 2 + 1 + one null row for the empty run
