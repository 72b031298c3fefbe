"""Benchmark run records: JSONL reader, file-name metadata, and a derivation
of run records / telemetry samples from the ``events`` table.

A run record is one JSON object per line; files are named
``<database>_<dd-mm-yyyy>_Run<n>.jsonl``.  The events table stands in for a
large run archive: each event is one timed run (``event_type`` = system,
``ts`` = run start, ``value`` = seconds) and one telemetry sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from domus.schema import RUN
from domus.sources.tables import table

# Use-case method names of the benchmark contract, in contract order.
USECASE_METHODS = (
    "usecase1_filter_properties",
    "usecase2_update_prices",
    "usecase3_add_solar_panels",
    "usecase4_price_analysis",
    "usecase5_average_price_per_city",
    "usecase6_filter_by_bedrooms_and_size",
    "usecase7_bulk_import",
)

FILE_NAME_PATTERN = r"^([^_]+)_(\d{2}-\d{2}-\d{4})_Run(\d+)"
RUN_ID_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Run JSONL files (a directory or glob) with an explicit schema, plus file name."""
    return (spark.read.schema(RUN).json(path)
            .withColumn("file_name", F.col("_metadata.file_name")))


def file_metadata(file_name: Column) -> list[Column]:
    """(database, run_date, run_number) parsed from a run file name."""
    return [
        F.regexp_extract(file_name, FILE_NAME_PATTERN, 1).alias("file_database"),
        F.try_to_date(F.regexp_extract(file_name, FILE_NAME_PATTERN, 2), "dd-MM-yyyy").alias("run_date"),
        F.regexp_extract(file_name, FILE_NAME_PATTERN, 3).try_cast("int").alias("run_number"),
    ]


def runs_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run record per event (flat columns of ``RUN`` plus ``file_name``)."""
    ev = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value")
    methods = F.array(*[F.lit(m) for m in USECASE_METHODS])
    return ev.select(
        F.col("event_id").alias("index"),
        F.date_format("ts", RUN_ID_FORMAT).alias("run_id"),
        F.col("event_type").alias("database"),
        F.concat(F.col("event_type"), F.lit("-db")).alias("container"),
        F.element_at(methods, (F.col("user_id") % 7 + 1).cast("int")).alias("usecase"),
        F.lit("Success").alias("status"),
        F.col("value").alias("execution_time_s"),
        (F.col("value") * 1000).cast("bigint").alias("execution_time_ms"),
        (F.col("value") * 1.5).alias("avg_cpu_percent"),
        (F.col("value") * 2.0).alias("peak_cpu_percent"),
        (F.col("user_id") + 1000).cast("double").alias("avg_mem_mb"),
        (F.col("user_id") + 1200).cast("double").alias("peak_mem_mb"),
        F.concat_ws("_", F.col("event_type"), F.date_format("ts", "dd-MM-yyyy"),
                    F.concat(F.lit("Run"), (F.col("event_id") % 12 + 1).cast("string"))).alias("file_stem"),
    ).withColumn("file_name", F.concat(F.col("file_stem"), F.lit(".jsonl"))).drop("file_stem")


def runs_with_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run record per event with the container samples taken while it ran:
    three each, and none for every tenth run."""
    ev = table(spark, sf_dir, "events", "event_id", "user_id", "value")

    def sample(i: int) -> Column:
        return F.struct((F.col("value") * (i + 1)).alias("cpu_percent"),
                        (F.col("user_id") + 8 * i).cast("double").alias("mem_mb"),
                        (F.col("event_id") * 4096 + F.lit(i * 1048576).cast("bigint")).alias("blkio_bytes"))

    taken = F.array(*[sample(i) for i in range(3)])
    return ev.select(F.col("event_id").alias("index"),
                     F.when(F.col("event_id") % 10 != 0, taken).alias("raw_samples"))


def samples_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry sample feed: one container sample per event."""
    ev = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value")
    return ev.select(
        F.col("event_type").alias("system"),
        F.col("ts"),
        F.col("value").alias("cpu_percent"),
        F.col("user_id").cast("double").alias("mem_mb"),
        (F.col("event_id") * 4096).alias("blkio_bytes"),
    )


def snapshots_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container metric snapshots (the counters CPU % and block I/O derive from)."""
    ev = table(spark, sf_dir, "events", "event_id", "user_id", "value")
    blk = F.struct
    return ev.select(
        F.col("event_id"),
        (F.round(F.col("value") * 1000000).cast("bigint") + F.col("event_id")).alias("cpu_total"),
        F.col("event_id").alias("precpu_total"),
        (F.col("event_id") * 10 + (F.col("user_id") % 5) * 10000000).alias("system_cpu"),
        (F.col("event_id") * 10).alias("presystem_cpu"),
        F.when(F.col("user_id") % 7 != 0, (F.col("user_id") % 4).cast("int")).alias("online_cpus"),
        (F.col("user_id") * 1048576).alias("mem_usage"),
        F.array(blk((F.col("event_id") * 512).alias("value")),
                blk((F.col("user_id") * 100).alias("value")),
                blk(F.lit(None).cast("bigint").alias("value"))).alias("blkio"),
    )
