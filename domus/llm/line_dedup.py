"""Line dedup over levelled sorted runs (DataFrame functions only).

Documents come in batches by ascending id.  A run is a sorted, bucketed table
of the line hashes that one batch added, with the first document of each.  A
batch merge-anti-joins the runs: hashes found there belong to an earlier
document, the rest form the batch's own run.  When a level holds ``fanout``
runs they are merged into one sorted run of the next level, so a batch reads
a number of runs that grows with the logarithm of the number of batches.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from domus.llm.common import ASCII_SPACE, cut, drop, lower_ascii, shuffle_partitions, text_or_empty
from domus.session import scratch_path

H = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """Stripped of ASCII white space at both ends, A-Z lower-cased."""
    return lower_ascii(F.btrim(line, F.lit(ASCII_SPACE)))


class SortedRuns:
    """Levels of disjoint runs (h1, h2, owner), bucketed and sorted by hash.

    All runs share one bucket count, so a batch that is hash-partitioned the
    same way joins each run bucket by bucket without another shuffle.
    """

    def __init__(self, spark: SparkSession, fanout: int = 2):
        self.spark, self.fanout, self.levels = spark, fanout, [[]]
        self.buckets = shuffle_partitions(spark)

    def tables(self) -> list[str]:
        return [t for level in self.levels for t in level]

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        rows.repartition(self.buckets, *H).write.bucketBy(self.buckets, *H).sortBy(*H) \
            .option("path", scratch_path(self.spark, name)).format("parquet").saveAsTable(name)
        return name

    def unseen(self, keys: DataFrame) -> DataFrame:
        for t in self.tables():
            keys = keys.join(self.spark.table(t).select(*H).hint("merge"), H, "left_anti")
        return keys

    def add(self, rows: DataFrame) -> None:
        self.levels[0].append(self._write(rows))
        for i, level in enumerate(self.levels):
            if len(level) < self.fanout:
                break
            merged = self.spark.table(level[0])
            for t in level[1:]:
                merged = merged.union(self.spark.table(t))
            name = self._write(merged)
            for t in level:
                self._remove(t)
            self.levels[i] = []
            if i + 1 == len(self.levels):
                self.levels.append([])
            self.levels[i + 1].append(name)

    def _remove(self, name: str) -> None:
        files = self.spark.table(name).inputFiles()[:1]
        self.spark.sql(f"DROP TABLE {name}")
        for f in files:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(f).getParent()
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def close(self) -> None:
        for t in self.tables():
            self._remove(t)
        self.levels = [[]]


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10,
                   batches: int = 4, fanout: int = 2) -> DataFrame:
    """(doc_id, content, pos): positions of lines that an earlier document holds.

    ``content`` is a hash of the text, so rows that repeat an id with other
    text keep their own positions.  Batches are id ranges from a sketch of
    the ids' quantiles; any boundaries give the same result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")) \
        .where(F.col("doc_id").isNotNull())
    edges = rows.select(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0] \
        if batches > 1 else None
    batch = F.lit(0)
    for e in sorted(set(edges or [])):
        batch = batch + (F.col("doc_id") > e).cast("int")
    lines = rows.select("doc_id", F.xxhash64("text").alias("content"), F.posexplode(F.split("text", "\n", -1))) \
        .select("doc_id", "content", "pos", line_key(F.col("col")).alias("key")).where(F.length("key") >= min_chars)
    seen = cut(lines.select("doc_id", "content", "pos", F.xxhash64("key").alias("h1"),
                            F.xxhash64(F.lit(1), F.reverse("key")).alias("h2"), batch.alias("batch")), "line-hashes")
    runs, gone = SortedRuns(spark, fanout), []
    for b in range(len(set(edges or [])) + 1):
        own = seen.where(F.col("batch") == b)
        first = cut(own.groupBy(*H).agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")), "line-first")
        fresh = cut(runs.unseen(first), "line-fresh")
        # owner null: an earlier batch holds the line
        shared = first.join(fresh.select(*H), H, "left_anti").select(*H, F.lit(None).cast("long").alias("owner")) \
            .union(fresh.where("owner < last").select(*H, "owner"))
        shared = cut(shared, "line-shared")
        gone.append(cut(own.join(shared, H).where("owner is null or doc_id > owner")
                        .select("doc_id", "content", "pos"), "line-gone"))
        runs.add(fresh.select(*H, "owner"))
        drop(first, fresh, shared)
    runs.close()
    drop(seen)
    out = gone[0]
    for g in gone[1:]:
        out = out.union(g)
    return out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10,
                batches: int = 4, fanout: int = 2, counts: bool = True) -> DataFrame:
    """``docs`` with ``text_col`` without the lines that an earlier document holds;
    with ``counts`` two columns more, n_lines and n_dropped, which take the place
    of columns of these names.

    A text is split at \\n; null or empty counts as one empty line, and a null
    text stays null.  A line's key has at least ``min_chars`` code points.  All
    lines with a key found under two ids go, but for those under the smallest
    id.  Rows with a null id neither hold nor lose lines.  Rows that repeat an
    id are one document here: a line found only in them stays in each.
    """
    gone = repeated_lines(docs, id_col, text_col, min_chars, batches, fanout) \
        .groupBy("doc_id", "content").agg(F.collect_set("pos").alias("gone"))
    # the row travels as one struct, so that its names meet none of these
    left = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("row"),
                       F.col(id_col).alias("id"), F.col(text_col).isNull().alias("no_text"),
                       F.xxhash64(text_or_empty(text_col)).alias("key"),
                       F.split(text_or_empty(text_col), "\n", -1).alias("lines"))
    both = left.join(gone, (left["id"] == gone["doc_id"]) & (left["key"] == gone["content"]), "left")
    n = F.size("lines")
    kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.transform(
        F.array_except(F.sequence(F.lit(0), n - 1), F.col("gone")), lambda i: F.get("lines", i)))
    text = F.when(~F.col("no_text"), F.array_join(kept, "\n"))
    extra = {"n_lines": n.cast("long"),
             "n_dropped": F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long")} if counts else {}
    return both.select(*[text.alias(c) if c == text_col else F.col("row").getField(c).alias(c)
                         for c in docs.columns if c not in extra], *[c.alias(name) for name, c in extra.items()])
