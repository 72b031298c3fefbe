"""ST1: incremental bulk import of cleaned-CSV files with Structured Streaming.

New files in ``source_dir`` are picked up ``max_files_per_trigger`` at a time.
Each micro-batch is parsed (same expressions as the batch import) and written
to ``target/batch=<epoch>`` with overwrite.  A micro-batch replayed after a
failure therefore rewrites the same directory (no duplicates), and the
checkpoint records which files were consumed.  Per-batch counts come from an
``Observation`` on the batch write.

With ``on_duplicate="skip"`` those rows are staged, and a second stream keeps
the natural keys it has seen as state, so a micro-batch costs its own rows
however many were imported before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from domus.functions.ids import LOW_BITS, with_batch_ids
from domus.operators.cleaning import parse_listings_with_reasons, to_wide_listing
from domus.plans.engine import NATURAL_KEY
from domus.schema import CLEAN_CSV, LISTING
from domus.session import materialize, path_exists

BATCH_LOG_SCHEMA = "batch_id long, imported long, rejected long, skipped long"
KEPT_LOG_SCHEMA = "batch_id long, kept long"

# state on the executors' disks, each batch uploading its own changes
KEY_STATE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def _own_target(spark: SparkSession, target: str, checkpoint: str) -> None:
    if path_exists(spark, target) and not path_exists(spark, checkpoint):
        raise ValueError(f"{target} belongs to another checkpoint: its batches would be written over")


def _trigger(writer, available_now: bool):
    return writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")


def import_stream(spark: SparkSession, source_dir: str, target: str, checkpoint: str,
                  max_files_per_trigger: int | None = 1, available_now: bool = True, on_duplicate: str = "append"):
    """Start the streaming import; returns the ``StreamingQuery`` that writes ``target``.

    A micro-batch takes ``max_files_per_trigger`` files, with None all that wait,
    and reads them in the order of their names.

    ``on_duplicate="append"`` imports every valid row (a replayed batch still
    overwrites its own directory, so replays never duplicate).
    ``"skip"`` keeps one row per natural key, the first that was read: the
    import goes to ``<checkpoint>_rows`` and ``keep_first_stream`` takes it
    from there.  With ``available_now`` the import has ended when this
    returns; otherwise both streams run, and
    ``spark.streams.awaitAnyTermination()`` waits for either.
    """
    if on_duplicate not in ("append", "skip"):
        raise ValueError("on_duplicate must be 'append' or 'skip'")
    if on_duplicate == "append":
        return _import(spark, source_dir, target, checkpoint, max_files_per_trigger, available_now)
    _own_target(spark, target, checkpoint)
    base = checkpoint.rstrip("/")
    lines = _import(spark, source_dir, f"{base}_rows", f"{base}_lines", max_files_per_trigger, available_now)
    if available_now:
        lines.awaitTermination()
    return keep_first_stream(spark, f"{base}_rows", target, checkpoint, available_now)


def _import(spark: SparkSession, source_dir: str, target: str, checkpoint: str, max_files_per_trigger: int | None,
            available_now: bool):
    _own_target(spark, target, checkpoint)
    reader = spark.readStream.schema(CLEAN_CSV).option("header", True)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    text = (reader.csv(source_dir)
            .select("*", F.col("_metadata.file_path").alias("src_file"),
                    F.col("_metadata.file_block_start").alias("src_block")))

    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        # ids: (batch number << 40) + position of the input row; a replayed
        # batch reads the same files in the same order, so it gets the same ids
        parsed = parse_listings_with_reasons(with_batch_ids(batch, epoch_id + 1, "src_pos", ("src_file", "src_block")))
        ok = F.size("reasons") == 0
        obs = Observation(f"import_batch_{epoch_id}")
        parsed_obs = parsed.observe(obs, F.count(F.when(ok, F.lit(1))).alias("valid"),
                                    F.count(F.when(~ok, F.lit(1))).alias("rejected"))
        rows = to_wide_listing(parsed_obs.where(ok).drop("reasons"))
        out = f"{target.rstrip('/')}/batch={epoch_id}"
        rows.write.mode("overwrite").parquet(out)
        try:
            m = obs.get
            valid, rejected = int(m["valid"]), int(m["rejected"])
        except Exception:  # metrics not reported: count explicitly
            c = parsed.agg(F.count(F.when(ok, F.lit(1))).alias("v"), F.count(F.when(~ok, F.lit(1))).alias("r")).first()
            valid, rejected = int(c["v"]), int(c["r"])
        imported = spark.read.parquet(out).count()
        log = spark.createDataFrame([(epoch_id, imported, rejected, valid - imported)], BATCH_LOG_SCHEMA)
        log.coalesce(1).write.mode("overwrite").json(f"{checkpoint.rstrip('/')}_counts/batch={epoch_id}")

    return _trigger(text.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint), available_now).start()


def first_ids(rows: DataFrame) -> DataFrame:
    """Of a stream of listings, the ids of the rows whose natural key (NULLs equal) no
    earlier micro-batch held; of rows with one key in a micro-batch the least id.

    The state of a key is three numbers: its least id and the times of the
    first and the last micro-batch that held it.  A micro-batch returns every
    key that it touches, and those are new whose two times agree.  The time of
    a micro-batch is in the checkpoint, so a replay gives the same ids.
    """
    seen = rows.select(*NATURAL_KEY, "listing_id", F.current_timestamp().alias("_at"))
    keys = seen.groupBy(*NATURAL_KEY).agg(F.min("listing_id").alias("listing_id"), F.min("_at").alias("_first"),
                                          F.max("_at").alias("_last"))
    return keys.where("_first = _last").select("listing_id")


def rows_with_ids(spark: SparkSession, rows_path: str, ids: DataFrame) -> DataFrame:
    """The imported rows with some ids, from the folders of their import batches alone."""
    number = F.shiftright("listing_id", LOW_BITS) - 1
    batches = [r[0] for r in ids.select(number.cast("int")).distinct().collect()]  # a number for each import batch
    rows = spark.read.schema(LISTING).parquet(*[f"{rows_path.rstrip('/')}/batch={b}" for b in sorted(batches)]) \
        if batches else spark.createDataFrame([], LISTING)
    return rows.join(ids, "listing_id", "left_semi")


def keep_first_stream(spark: SparkSession, rows_path: str, target: str, checkpoint: str, available_now: bool = True):
    """Start the stream that moves imported rows whose natural key is new to ``target``.

    ``rows_path`` is what an ``append`` import writes.  The state grows with
    the number of distinct keys; it is kept in RocksDB, in as many parts as
    ``spark.sql.shuffle.partitions`` says at the first start.  Rows that an
    import batch writes again after a failure have their ids and keys already
    in the state, so they aren't written twice.
    """
    _own_target(spark, target, checkpoint)
    folder = spark._jvm.org.apache.hadoop.fs.Path(rows_path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)  # nothing may be imported yet

    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        ids = materialize(batch, "stream-first-ids")  # the state is read and written once
        rows_with_ids(batch.sparkSession, rows_path, ids).write.mode("overwrite").parquet(f"{target.rstrip('/')}/batch={epoch_id}")
        ids.groupBy((F.shiftright("listing_id", LOW_BITS) - 1).alias("batch_id")).agg(F.count(F.lit(1)).alias("kept")) \
            .coalesce(1).write.mode("overwrite").json(f"{checkpoint.rstrip('/')}_kept/batch={epoch_id}")

    before = {k: spark.conf.get(k, None) for k in KEY_STATE}
    try:
        for k, v in KEY_STATE.items():
            spark.conf.set(k, v)
        ids = first_ids(spark.readStream.schema(LISTING).parquet(rows_path))
        w = ids.writeStream.outputMode("update").foreachBatch(write_batch).option("checkpointLocation", checkpoint)
        return _trigger(w, available_now).start()  # the query has a copy of the settings
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def batch_counts(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Rows that each import batch read: imported, rejected and, under the ``skip`` policy, left out."""
    base = checkpoint.rstrip("/")
    if not path_exists(spark, f"{base}_lines"):
        return spark.read.schema(BATCH_LOG_SCHEMA).json(f"{base}_counts")
    read = spark.read.schema(BATCH_LOG_SCHEMA).json(f"{base}_lines_counts")
    kept = spark.read.schema(KEPT_LOG_SCHEMA).json(f"{base}_kept").groupBy("batch_id").agg(F.sum("kept").alias("kept"))
    n = F.coalesce("kept", F.lit(0))
    return read.join(kept, "batch_id", "left").select("batch_id", n.alias("imported"), "rejected",
                                                      (F.col("imported") - n).alias("skipped"))
