"""Exact top-k search by exhaustive term-at-a-time accumulation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _matrix(col: pa.ChunkedArray) -> np.ndarray:
    """Integer list column as a dense row matrix, short rows padded with 0."""
    arr = col.combine_chunks()
    lens = np.diff(arr.offsets.to_numpy())
    flat = arr.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(lens.max()) if len(lens) else 0
    out = np.zeros((len(lens), width), np.int64)
    out[np.arange(width)[None, :] < lens[:, None]] = flat
    return out


def accumulate(queries: np.ndarray, rows: np.ndarray):
    """Yield the score array of each query: every non-zero query term scatters
    its weight times the term's postings into a dense array over all rows."""
    postings = []
    for term in range(rows.shape[1]):
        at = np.flatnonzero(rows[:, term])
        postings.append((slice(None) if len(at) == len(rows) else at, rows[at, term]))
    for q in queries:
        scores = np.zeros(len(rows), np.int64)
        for term in np.flatnonzero(q[:len(postings)]):
            at, weights = postings[term]
            scores[at] += q[term] * weights
        yield scores


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    at = np.arange(len(scores))
    if len(scores) > k:  # partition selection keeps all ties with the k-th
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def topk_search(df: DataFrame, id_col: str, vec_col: str, is_query: Column, k: int = 10, scale: float = 1024.0,
                part_rows: int = 1024, query_rows: int = 512) -> DataFrame:
    """(query_id, rank, id, score): the k rows with the highest integer inner
    product for each query row, by ``floor(scale * component)``.

    Rows are dealt into parts of about ``part_rows`` by a hash, queries into
    blocks of about ``query_rows``; each (part, block) is one bounded group
    that scores every row of the part for every query of the block and keeps
    k rows a query; a window merges the parts.  No score is skipped.

    Null or empty tables give no rows.  Rows take no part if the id or the
    vector is null or a component is null or not finite.  Vectors of other
    lengths are scored as if padded with zeros; an empty vector scores 0
    everywhere.  A query never returns rows of its own id.  Repeated rows of
    other ids are returned each; repeated equal query rows count as one.
    Other columns of ``df`` are not read.
    """
    x = F.col("v")
    ok = F.col("id").isNotNull() & x.isNotNull() & ~F.exists(
        x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    base = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"),
                     F.coalesce(is_query, F.lit(False)).alias("q")).where(ok) \
        .select("id", "q", F.transform(x, lambda c: F.floor(c * F.lit(scale)).cast("long")).alias("w"))
    n, nq = base.agg(F.count("*"), F.count(F.when(F.col("q"), 1))).first()
    parts, blocks = max(1, -(-n // part_rows)), max(1, -(-nq // query_rows))
    deal = F.xxhash64("id", "w")
    left = base.withColumn("part", F.pmod(deal, F.lit(parts).cast("long"))) \
        .select("id", "w", "part", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    right = base.where("q").select("id", "w").distinct().withColumn("block", F.pmod(deal, F.lit(blocks)).cast("int")) \
        .select("id", "w", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"))

    def score(rows: pa.Table, queries: pa.Table) -> pa.Table:
        ids, m = rows["id"].to_numpy(), _matrix(rows["w"])
        qids, q = queries["id"].to_numpy(), _matrix(queries["w"])
        out: list[tuple] = []
        if len(ids) and len(qids):
            for qid, qrow, scores in zip(qids, q, accumulate(q, m)):
                other = np.flatnonzero(ids != qid)
                at = other[best(scores[other], ids[other], k)]
                key = hash_row(qrow)
                out.append((np.full(len(at), qid), np.full(len(at), key), ids[at], scores[at]))
        cols = [np.concatenate(c) if out else np.empty(0, np.int64) for c in (zip(*out) if out else [()] * 4)]
        return pa.table(dict(zip(("query_id", "query_key", "id", "score"), cols)))

    found = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(
        score, "query_id long, query_key long, id long, score long")
    w = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k) \
        .select("query_id", "rank", "id", "score")


def hash_row(row: np.ndarray) -> int:
    """A number that tells apart different query rows of one id."""
    import zlib
    return zlib.crc32(np.trim_zeros(row, "b").tobytes())
