"""Writers: cleaned CSV, clustered wide table, documents, star tables, run
records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from domus.operators.cleaning import format_clean_csv
from domus.operators.star import star_tables
from domus.session import scratch_path

CLUSTER_KEYS = ("city", "state", "zip_code", "listing_id")


def write_clean_csv(clean: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """K1: header, '%.2f' floats, 'yyyy-MM-dd HH:mm:ss' dates, NULL as empty field."""
    (format_clean_csv(clean).write.mode(mode)
     .option("header", True).option("nullValue", "").option("emptyValue", "")
     .csv(path))


def clustered(listings: DataFrame, partitions: int | None = None) -> DataFrame:
    """Co-locate and sort rows by (city, state, zip_code, listing_id) for writing.

    A ``rebalance`` on (city, state) hash-clusters each city into few files;
    AQE sizes the partitions from the measured shuffle and splits a skewed
    one (a city holding a third of all rows is spread over many tasks), with
    no extra sampling pass over the input.  Sorted files give tight Parquet
    min/max statistics for city / zip predicates.
    """
    args = ([partitions] if partitions else []) + ["city", "state"]
    return listings.hint("rebalance", *args).sortWithinPartitions(*CLUSTER_KEYS)


def import_wide(listings: DataFrame, path: str, mode: str = "append",
                max_records_per_file: int = 0) -> int:
    """K2: write the wide table clustered; returns the number of rows written.

    The count comes from an ``Observation`` on the write itself (no second
    pass over the data).
    """
    obs = Observation("import_wide")
    out = clustered(listings).observe(obs, F.count(F.lit(1)).alias("rows"))
    w = out.write.mode(mode)
    if max_records_per_file:
        w = w.option("maxRecordsPerFile", max_records_per_file)
    w.parquet(path)
    return int(obs.get["rows"])


def write_documents(docs: DataFrame, path: str, mode: str = "errorifexists", fmt: str = "parquet") -> None:
    """K3: nested documents as Parquet (or JSON lines)."""
    docs.write.mode(mode).format(fmt).save(path)


def write_star(listings: DataFrame, base: str, mode: str = "errorifexists") -> dict[str, str]:
    """K4: stage once to the shared checkpoint folder, then write the eight tables.

    Staging to storage (not cache) cuts the lineage: a lost executor re-reads
    staged files instead of recomputing the whole import.  Returns paths.
    """
    spark = listings.sparkSession
    stage = scratch_path(spark, "star-staging")
    listings.write.parquet(stage)
    staged = spark.read.parquet(stage)
    paths = {}
    for name, df in star_tables(staged).items():
        p = f"{base.rstrip('/')}/{name}"
        df.write.mode(mode).parquet(p)
        paths[name] = p
    return paths


def read_star(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    return {k: spark.read.parquet(p) for k, p in paths.items()}


def write_runs_jsonl(runs: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per line."""
    runs.write.mode(mode).json(path)
