"""Parsing and windowing give the same results in a non-UTC session time zone."""
import datetime as dt

from pyspark.sql import functions as F

from domus.functions.parse import to_utc_timestamp_ntz
from domus.streaming import telemetry

TEXTS = ["2020-01-01", "2020-01-01 05:06:07", "2020-01-01T00:00:00+02:00", "2020-01-01T03:00:00Z",
         "2020-06-30T23:30:00-01:30", "not a date", ""]
WANT = [dt.datetime(2020, 1, 1), dt.datetime(2020, 1, 1, 5, 6, 7), dt.datetime(2019, 12, 31, 22),
        dt.datetime(2020, 1, 1, 3), dt.datetime(2020, 7, 1, 1), None, None]


def parse_all(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    return [r[0] for r in df.select(to_utc_timestamp_ntz("t")).collect()]


def test_parse_independent_of_session_zone(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        for tz in ("UTC", "Asia/Kolkata", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", tz)
            assert parse_all(spark) == WANT, tz
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_stream_windows_independent_of_session_zone(spark, tmpdir_path):
    old = spark.conf.get("spark.sql.session.timeZone")
    rows = [(1, dt.datetime(2024, 1, 1, 0, 30), 1, "a", 1.0, None),
            (2, dt.datetime(2024, 1, 1, 23, 30), 2, "a", 3.0, None),
            (3, dt.datetime(2024, 1, 2, 0, 10), 3, "a", 5.0, None)]
    spark.createDataFrame(rows, telemetry.EVENTS).coalesce(1).write.parquet(f"{tmpdir_path}/ev")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
        q = telemetry.telemetry_stream(spark, f"{tmpdir_path}/ev", f"{tmpdir_path}/out", f"{tmpdir_path}/ck")
        q.awaitTermination()
        got = {(r["window_start"], r["samples"]) for r in telemetry.latest_windows(spark, f"{tmpdir_path}/out").collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert got == {(dt.datetime(2024, 1, 1), 2), (dt.datetime(2024, 1, 2), 1)}
