"""ST2: telemetry summary over a live sample feed, per tumbling event-time window.

Samples arrive as files in any order.  Each micro-batch writes mergeable
partials (sums, counts, extremes) per system and window to
``out/level=0/run=<epoch>`` (overwrite, so a replayed batch is idempotent).
Every ``fan`` runs of a level are merged into one run of the next, named by
its place, so the windows are read from at most ``fan - 1`` runs a level, a
number that grows with the logarithm of the epochs.  No sample is ever late:
a file that arrives long after its window still adds to it, and the stream
keeps no state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from domus.functions.measures import round_half_up
from domus.session import path_exists

MB = 1048576.0
FAN = 8  # runs of a level that make one of the next

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])


def windowed_partials(samples: DataFrame, window: str = "1 day") -> DataFrame:
    """Mergeable partials per window of samples with columns system, ts,
    cpu_percent, mem_mb, blkio_bytes."""
    return (samples.groupBy(F.window("ts", window).alias("w"), "system")
            .agg(F.sum("cpu_percent").alias("cpu_sum"), F.count("cpu_percent").alias("cpu_n"),
                 F.max("cpu_percent").alias("_peak_cpu"), F.sum("mem_mb").alias("mem_sum"),
                 F.count("mem_mb").alias("mem_n"), F.max("mem_mb").alias("_peak_mem"),
                 F.max("blkio_bytes").alias("_blk_max"), F.min("blkio_bytes").alias("_blk_min"),
                 F.count(F.lit(1)).alias("samples")))


def combine_partials(partials: DataFrame) -> DataFrame:
    """One row of partials per window from any number of them."""
    how = {"cpu_sum": F.sum, "cpu_n": F.sum, "_peak_cpu": F.max, "mem_sum": F.sum, "mem_n": F.sum,
           "_peak_mem": F.max, "_blk_max": F.max, "_blk_min": F.min, "samples": F.sum}
    return partials.groupBy("w", "system").agg(*[f(c).alias(c) for c, f in how.items()])


def merge_partials(partials: DataFrame) -> DataFrame:
    """One row per window from any number of partials."""
    return (partials.groupBy("w", "system")
            .agg(F.try_divide(F.sum("cpu_sum"), F.sum("cpu_n")).alias("_avg_cpu"), F.max("_peak_cpu").alias("_peak_cpu"),
                 F.try_divide(F.sum("mem_sum"), F.sum("mem_n")).alias("_avg_mem"), F.max("_peak_mem").alias("_peak_mem"),
                 F.max("_blk_max").alias("_blk_max"), F.min("_blk_min").alias("_blk_min"),
                 F.sum("samples").alias("samples")))


def _utc_wall_clock(instant: str) -> F.Column:
    """Instant -> naive UTC wall clock, whatever the session time zone."""
    return F.convert_timezone(None, F.lit("UTC"), F.col(instant).cast("timestamp_ntz"))


def _finish(df: DataFrame) -> DataFrame:
    return df.select(
        "system", _utc_wall_clock("w.start").alias("window_start"),
        _utc_wall_clock("w.end").alias("window_end"),
        round_half_up("_avg_cpu", 2).alias("avg_cpu"), round_half_up("_peak_cpu", 2).alias("peak_cpu"),
        round_half_up("_avg_mem", 2).alias("avg_mem"), round_half_up("_peak_mem", 2).alias("peak_mem"),
        round_half_up((F.col("_blk_max") - F.col("_blk_min")) / MB, 2).alias("total_blkio_mb"),
        "samples")


def samples_stream(spark: SparkSession, events_path: str, max_files_per_trigger: int = 1) -> DataFrame:
    """Sample feed from a folder of event files, or from one event file."""
    reader = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", max_files_per_trigger)
    p = spark._jvm.org.apache.hadoop.fs.Path(events_path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile():
        folder, name = events_path.rstrip("/").rsplit("/", 1)
        ev = reader.option("pathGlobFilter", name).parquet(folder)
    else:
        ev = reader.parquet(events_path)
    # windows need an instant (TIMESTAMP); ``ts`` is a naive UTC wall clock:
    # move it to the session zone's wall clock first so the cast yields the UTC instant
    session_tz = spark.conf.get("spark.sql.session.timeZone")
    instant = F.convert_timezone(F.lit("UTC"), F.lit(session_tz), F.col("ts")).cast("timestamp")
    return ev.select(F.col("event_type").alias("system"), instant.alias("ts"),
                     F.col("value").alias("cpu_percent"),
                     F.col("user_id").cast("double").alias("mem_mb"),
                     (F.col("event_id") * 4096).alias("blkio_bytes"))


def _run_path(out: str, level: int, run: int) -> str:
    return f"{out.rstrip('/')}/level={level}/run={run}"


def _complete_runs(spark: SparkSession, out: str) -> dict[int, set[int]]:
    """Runs that were written to the end, by level (a few names a level: merged
    ones are removed)."""
    found = spark._jvm.org.apache.hadoop.fs.Path(f"{out.rstrip('/')}/level=*/run=*/_SUCCESS")
    runs: dict[int, set[int]] = {}
    for f in found.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(found) or []:
        level, run = (int(part.split("=")[1]) for part in f.getPath().toString().split("/")[-3:-1])
        runs.setdefault(level, set()).add(run)
    return runs


def add_partials(partials: DataFrame, out: str, epoch_id: int, fan: int = FAN) -> None:
    """Write one epoch's partials, then merge every level that it completes.

    A run that is complete is never written again, so a replayed epoch changes
    nothing.  What a run was merged from stays until the run above it is
    complete, for those who listed it before; then it is removed.
    """
    spark = partials.sparkSession
    partials.write.mode("overwrite").parquet(_run_path(out, 0, epoch_id))
    level, run = 0, epoch_id
    while (run + 1) % fan == 0:
        level, run = level + 1, run // fan
        done = _complete_runs(spark, out)
        if run not in done.get(level, ()):
            parts = range(run * fan, (run + 1) * fan)
            if not done.get(level - 1, set()).issuperset(parts):
                raise RuntimeError(f"{out}: runs {parts} of level {level - 1} are not complete")
            combine_partials(spark.read.parquet(*[_run_path(out, level - 1, r) for r in parts])) \
                .write.mode("overwrite").parquet(_run_path(out, level, run))
        for old in done.get(level - 2, set()) if level > 1 else ():
            if old // fan ** 2 == run:
                p = spark._jvm.org.apache.hadoop.fs.Path(_run_path(out, level - 2, old))
                p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def current_runs(spark: SparkSession, out: str, fan: int = FAN) -> list[str]:
    """Paths of the complete runs that no complete run of a higher level holds."""
    done = _complete_runs(spark, out)
    top = max(done, default=0)
    return [_run_path(out, level, run) for level in sorted(done) for run in sorted(done[level])
            if not any(run // fan ** (up - level) in done.get(up, ()) for up in range(level + 1, top + 1))]


def telemetry_stream(spark: SparkSession, events_path: str, out: str, checkpoint: str,
                     window: str = "1 day", available_now: bool = True, max_files_per_trigger: int = 1):
    """Start the windowed telemetry stream; returns the ``StreamingQuery``."""
    if path_exists(spark, out) and not path_exists(spark, checkpoint):
        raise ValueError(f"{out} belongs to another checkpoint: epochs would start at 0 again")

    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        add_partials(windowed_partials(batch, window), out, epoch_id)

    w = (samples_stream(spark, events_path, max_files_per_trigger).writeStream.foreachBatch(write_batch)
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def latest_windows(spark: SparkSession, out: str, fan: int = FAN) -> DataFrame:
    """Current result: one row per (system, window) over all samples so far."""
    runs = current_runs(spark, out, fan)
    if not runs:
        raise FileNotFoundError(f"no complete run under {out}")
    return _finish(merge_partials(spark.read.parquet(*runs)))
