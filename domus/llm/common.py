"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from domus.session import scratch_path

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_SPACE = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    The read side has no lineage: a lost executor costs a re-read of files,
    and every branch that uses the frame scans it instead of recomputing.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def drop(*frames: DataFrame) -> None:
    """Remove tables written by ``cut`` that no later plan reads."""
    for f in frames:
        path = getattr(f, "_staged_path", None)
        if path:
            p = f.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(f.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z and nothing else (``lower`` also maps other letters)."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)) \
        .otherwise(F.translate(c, ASCII_UPPER, ASCII_UPPER.lower()))


def text_or_empty(c: str = "text") -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def connected_components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(id, component): smallest id reachable, for every id that has an edge.

    ``edges`` (src, dst) in any direction.  Rounds of minimum-neighbour
    labels plus one pointer jump, each round written to the shared folder;
    ends when a round changes no label.  Aggregates combine inside each task
    and joins are plain equi-joins that AQE may split, so a hub holding a
    third of the links does not meet one task.  Only the count of changed
    labels reaches the driver.
    """
    both = cut(edges.select("src", "dst").union(edges.select(F.col("dst"), F.col("src")))
               .where("src <> dst"), f"{name}-edges")
    labels = cut(both.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("m"))
                 .select("id", F.least("id", "m").alias("component")), f"{name}-labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "dst"), "dst") \
            .groupBy(F.col("src").alias("id")).agg(F.min("component").alias("m"))
        step = cut(labels.join(near, "id").select(
            "id", F.col("component").alias("old"), F.least("component", "m").alias("component")), f"{name}-step")
        jump = step.select(F.col("id").alias("component"), F.col("component").alias("up"))
        new = cut(step.join(jump, "component").select("id", "old", F.least("component", "up").alias("component")),
                  f"{name}-labels")
        changed = new.where("component <> old").limit(1).count()
        drop(labels, step)
        labels = new
        if not changed:
            drop(both)
            return labels.select("id", "component")


def tokenizer_path() -> str:
    """Place of the vocabulary file; resolved on the executor that reads it."""
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")
