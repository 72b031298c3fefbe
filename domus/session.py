"""SparkSession helpers.

Cluster settings (shuffle partitions, checkpoint dir, memory) belong to the
cluster; ``get_spark`` only fills in values that are still unset, so the same
code runs on ``local[8]`` in tests and on a large cluster unchanged.
"""

from __future__ import annotations

import os
import tempfile

from pyspark import SparkConf
from pyspark.sql import SparkSession

# Settings every job relies on: runtime re-planning (AQE) for join strategy,
# partition coalescing and skew splitting, UTC for all timestamp parsing.
_REQUIRED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}

# Defaults for a local master only; on a cluster sizes belong to its configuration.
_LOCAL_DEFAULTS = {
    "spark.sql.shuffle.partitions": "8",
    "spark.driver.memory": "8g",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def settings_for(master: str, submitted: dict[str, str]) -> dict[str, str]:
    """The settings that the code itself chooses: what every job relies on, and
    for a local master the local defaults that are still unset."""
    out = dict(_REQUIRED)
    if master.startswith("local"):
        out |= {k: v for k, v in _LOCAL_DEFAULTS.items() if k not in submitted}
    return out


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists; any other fault is raised, not taken for absence."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def get_spark(master: str | None = None, app_name: str = "domus") -> SparkSession:
    """Return the active session, or build a local one with sane defaults."""
    active = SparkSession.getActiveSession()
    if active is not None:
        ensure_checkpoint_dir(active)
        return active
    builder = SparkSession.builder.appName(app_name)
    if master is None:
        master = os.environ.get("DOMUS_MASTER", f"local[{os.environ.get('BENCH_CPUS', '8')}]")
    submitted = SparkConf()  # what spark-submit / spark-defaults already set
    if submitted.get("spark.master") is None:
        builder = builder.master(master)
    effective_master = submitted.get("spark.master") or master
    for k, v in settings_for(effective_master, dict(submitted.getAll())).items():
        builder = builder.config(k, v)
    if submitted.get("spark.checkpoint.dir") is None and effective_master.startswith("local"):
        # a local run without a configured folder: private scratch
        builder = builder.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="domus-ckpt-"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for k, v in _REQUIRED.items():
        if k.startswith("spark.sql."):
            spark.conf.set(k, v)
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; create a scratch one only if unset.

    On a cluster the setting names a shared folder (HDFS/S3/...), so written
    intermediate tables and ``checkpoint()`` survive executor loss; without
    it a cluster run stops with an error.  Only a local run without the
    setting gets a fresh temporary directory.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            # a machine-local folder is not visible to other executors
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (staging tables live there)")
        configured = tempfile.mkdtemp(prefix="domus-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for a written table."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tables/{name}-{os.getpid()}-{next(_counter)}"


def _count():
    i = 0
    while True:
        i += 1
        yield i


_counter = _count()


def materialize(df, name: str):
    """Write ``df`` once as Parquet under the shared checkpoint folder and read it back.

    Cuts the lineage for plans that use one expensive input in several
    branches: each branch scans the staged files (with pruning and pushdown)
    instead of recomputing the input, and a lost executor re-reads files
    rather than re-running the upstream joins.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
