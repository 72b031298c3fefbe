"""Run-record projection and telemetry aggregates (batch).

All aggregates are plain ``groupBy`` aggregations with map-side partial
aggregation; per-record sample arrays are summarized with higher-order
functions inside the row (no explode, no shuffle).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from domus.functions.measures import round_half_up
from domus.schema import USECASE_LABELS
from domus.sources.runs import RUN_ID_FORMAT, file_metadata

MB = 1048576.0


# ---------------------------------------------------------------- F23 / F24
def cpu_percent(cpu_total="cpu_total", precpu_total="precpu_total", system_cpu="system_cpu",
                presystem_cpu="presystem_cpu", online_cpus="online_cpus") -> Column:
    """cpu_delta / system_delta x cpus x 100; 0 unless both deltas > 0; cpus NULL/0 -> 1."""
    cpu_delta = F.col(cpu_total) - F.col(precpu_total)
    sys_delta = F.col(system_cpu) - F.col(presystem_cpu)
    cpus = F.coalesce(F.nullif(F.col(online_cpus), F.lit(0)), F.lit(1))
    pct = (cpu_delta / sys_delta) * cpus * 100.0
    return F.when((sys_delta > 0) & (cpu_delta > 0), pct).otherwise(F.lit(0.0))


def blkio_total(arr: str | Column = "blkio") -> Column:
    """Sum of per-device byte counters; a NULL entry or a missing list counts as 0."""
    a = F.col(arr) if isinstance(arr, str) else arr
    total = F.aggregate(a, F.lit(0).cast("bigint"), lambda acc, x: acc + F.coalesce(x["value"], F.lit(0)))
    return F.coalesce(total, F.lit(0).cast("bigint"))


def snapshot_metrics(snap: DataFrame) -> DataFrame:
    return snap.select("event_id", cpu_percent().alias("cpu_percent"),
                       (F.col("mem_usage") / MB).alias("mem_mb"),
                       blkio_total().alias("blkio_bytes"))


# ---------------------------------------------------------------- A7
def telemetry_summary(samples: DataFrame, keys=("system", "day")) -> DataFrame:
    """avg/peak CPU, avg/peak memory, block I/O (max - min, MB) and sample count per group."""
    df = samples.withColumn("day", F.to_date("ts")) if "day" in keys and "day" not in samples.columns else samples
    return df.groupBy(*keys).agg(
        round_half_up(F.avg("cpu_percent"), 2).alias("avg_cpu"),
        round_half_up(F.max("cpu_percent"), 2).alias("peak_cpu"),
        round_half_up(F.avg("mem_mb"), 2).alias("avg_mem"),
        round_half_up(F.max("mem_mb"), 2).alias("peak_mem"),
        round_half_up((F.max("blkio_bytes") - F.min("blkio_bytes")) / MB, 2).alias("total_blkio_mb"),
        F.count(F.lit(1)).alias("samples"),
    )


def summarize_samples(runs: DataFrame, arr: str = "raw_samples") -> DataFrame:
    """Per run record: the summary of its own sample array; empty/absent -> zeros."""
    s = F.coalesce(F.col(arr), F.array().cast(runs.schema[arr].dataType))
    n = F.size(s)

    def avg_of(field):
        total = F.aggregate(s, F.lit(0.0), lambda acc, x: acc + F.coalesce(x[field], F.lit(0.0)))
        return F.when(n > 0, round_half_up(total / n, 2)).otherwise(F.lit(0.0))

    def max_of(field):
        return F.coalesce(round_half_up(F.array_max(F.transform(s, lambda x: x[field])), 2), F.lit(0.0))

    blk = F.transform(s, lambda x: x["blkio_bytes"])
    io = F.when(n > 0, round_half_up((F.array_max(blk) - F.array_min(blk)) / MB, 2)).otherwise(F.lit(0.0))
    # withColumns replaces a same-named column already present in the record
    return runs.withColumns({
        "avg_cpu": avg_of("cpu_percent"), "peak_cpu": max_of("cpu_percent"),
        "avg_mem": avg_of("mem_mb"), "peak_mem": max_of("mem_mb"),
        "total_blkio_mb": io, "n_samples": n.cast("bigint"),
    })


def explode_samples(runs: DataFrame, arr: str = "raw_samples") -> DataFrame:
    """One row per sample (``$unwind`` + promote the element to columns); runs without samples kept."""
    return runs.select("database", "usecase", "run_id", F.explode_outer(arr).alias("s")) \
        .select("database", "usecase", "run_id", "s.*")


def device_counters(snap: DataFrame, arr: str = "blkio") -> DataFrame:
    """One row per device counter of a snapshot (array element promoted to a row).

    ``posexplode_outer`` keeps snapshots with an empty/NULL array as one row
    with NULL position; it is a per-row generator (no shuffle).
    """
    return (snap.select("event_id", F.posexplode_outer(arr).alias("device_pos", "d"))
            .select("event_id", "device_pos", F.col("d.value").alias("bytes")))


# ---------------------------------------------------------------- S4 / S5 / P7
def run_records(runs: DataFrame) -> DataFrame:
    """Flatten run records: timestamp, use-case number and clean name, metrics, file metadata."""
    first = F.split(F.col("usecase"), "_").getItem(0)
    return runs.select(
        "database",
        F.try_to_timestamp(F.col("run_id"), F.lit(RUN_ID_FORMAT)).cast("timestamp_ntz").alias("timestamp"),
        F.substring(first, -1, 1).try_cast("int").alias("usecase_number"),
        F.regexp_replace(F.regexp_replace("usecase", r"^[^_]*_?", ""), "_", " ").alias("usecase_name"),
        "execution_time_s",
        F.coalesce(F.col("execution_time_ms"), (F.col("execution_time_s") * 1000).cast("bigint"))
        .alias("execution_time_ms"),
        "avg_cpu_percent", "peak_cpu_percent", "avg_mem_mb", "peak_mem_mb",
        *file_metadata(F.col("file_name")),
    )


def runs_by_timestamp(records: DataFrame) -> DataFrame:
    """Records from the oldest to the newest, runs without a timestamp last."""
    return records.orderBy(F.asc_nulls_last("timestamp"), "database", "usecase_number")


# ---------------------------------------------------------------- A8 - A12
def mean_exec_by_usecase(records: DataFrame) -> DataFrame:
    return records.groupBy("usecase_name", "database") \
        .agg(round_half_up(F.avg("execution_time_s"), 4).alias("mean_execution_time_s"))


def mean_exec_by_day(records: DataFrame, usecase_number: int) -> DataFrame:
    return (records.where(F.col("usecase_number") == usecase_number)
            .groupBy(F.to_date("timestamp").alias("date_only"), "database")
            .agg(round_half_up(F.avg("execution_time_s"), 4).alias("mean_exec_time_s"))
            .orderBy("date_only", "database"))


def metric_quartiles(records: DataFrame,
                     metrics=("execution_time_s", "peak_cpu_percent", "avg_mem_mb"),
                     method: str = "rank", accuracy: int = 10000, digits: int = 6) -> DataFrame:
    """Box-plot statistics (min, quartiles, max) per system and metric.

    ``rank``: exact quantiles by narrowing (``ranking.exact_quantiles``), no
    group gathered in one task; a metric without values has no row.
    ``approx``: ``percentile_approx``, a mergeable sketch with relative rank
    error 1/accuracy.
    """
    from domus.operators.ranking import exact_quantiles
    if method not in ("rank", "approx"):
        raise ValueError("method must be 'rank' or 'approx'")
    long = records.unpivot(["database"], list(metrics), "metric", "v")
    probs = (0.25, 0.5, 0.75)
    keys = ["database", "metric"]
    if method == "rank":
        names = {0.0: "min", 0.25: "_q1", 0.5: "_q2", 0.75: "_q3", 1.0: "max"}
        qs = exact_quantiles(long, keys, "v", list(names))
        stats = qs.groupBy(*keys).agg(*[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(n)
                                        for p, n in names.items()])
        q1, q2, q3 = F.col("_q1"), F.col("_q2"), F.col("_q3")
    else:
        arr = F.array(*[F.lit(x) for x in probs])
        q = F.percentile_approx("v", arr, accuracy)
        stats = long.groupBy(*keys).agg(F.min("v").alias("min"), q.alias("_q"), F.max("v").alias("max"))
        q1, q2, q3 = F.col("_q")[0], F.col("_q")[1], F.col("_q")[2]
    return stats.select("database", "metric", round_half_up("min", digits).alias("min"),
                        round_half_up(q1, digits).alias("q1"), round_half_up(q2, digits).alias("median"),
                        round_half_up(q3, digits).alias("q3"), round_half_up("max", digits).alias("max"))


def usecase_label(number: Column) -> Column:
    m = F.create_map(*[x for k, v in USECASE_LABELS.items() for x in (F.lit(k), F.lit(v))])
    return m[number]


def mean_exec_chart(records: DataFrame) -> DataFrame:
    """Mean execution time per (use case, system) with display label, in contract order."""
    m = mean_exec_by_usecase(records.select("usecase_number", "usecase_name", "database", "execution_time_s"))
    nums = records.select("usecase_name", "usecase_number").dropDuplicates()
    return (m.join(nums, "usecase_name")
            .withColumn("label", usecase_label(F.col("usecase_number")))
            .orderBy("usecase_number", "database"))


def usecase_catalog(records: DataFrame) -> DataFrame:
    """Distinct (number, name) of use cases with display label, in contract order."""
    return (records.select("usecase_number", "usecase_name").dropDuplicates()
            .withColumn("label", F.concat(F.lit("uc "), F.col("usecase_number").cast("string"),
                                          F.lit(": "), usecase_label(F.col("usecase_number"))))
            .orderBy("usecase_number", "usecase_name"))
