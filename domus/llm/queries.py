"""Registered queries of the training-data operators, and their SQL.

Each query is thin: it applies its operator to the whole table and derives the
digest columns of the contract from the operator's own outputs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from domus.llm import (bpe, graph_index, line_dedup, merkle, minhash, packing, pii, secret_scan, spans, suffix, topk,
                       toxicity, vectors, whitening)
from domus.llm.common import read, tokenizer_path
from domus.llm.merkle_sql import merkle_sql
from domus.session import scratch_path


def sha(c: Column | str) -> Column:
    return F.sha2(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")).cast("binary"), 256)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text")) \
        .select("doc_id", "n_lines", "n_dropped", sha("text").alias("kept_sha256"))


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(read(spark, sf_dir, "embeddings"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(read(spark, sf_dir, "documents"), tokenizer_path).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        sha(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"),
        sha("decoded").alias("decoded_sha256"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, found = pii.find_pii(read(spark, sf_dir, "documents"))
    keys = ["doc_id", "content"]
    out = spans.with_digest(rows.select(*keys), spans.span_digest(found, keys, pii.KINDS), keys, pii.KINDS)
    return out.select("doc_id", *[f"n_{k}" for k in pii.KINDS], sha("base_spans").alias("base_sha256"), "spans")


def op6_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    ledger = secret_scan.BlobLedger(spark, scratch_path(spark, "blob-ledger"))
    versions = secret_scan.versions_of(docs)
    ledger.add(versions)
    kinds = secret_scan.KINDS
    found = ledger.findings().withColumn("base", F.lit(True))
    out = spans.with_digest(versions.select("path_id", "blob"), spans.span_digest(found, ["blob"], kinds),
                            ["blob"], kinds)
    return out.select(F.col("path_id").alias("doc_id"), *[f"n_{k}" for k in kinds],
                      sha("base_spans").alias("base_sha256"), "spans")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.topk_search(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 100 == 0) \
        .select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), width=2)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), tokenizer_path).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify_documents(read(spark, sf_dir, "documents")).select(
        "doc_id", "leaf", "subroot", "root", sha(merkle.proof_of(F.col("path"))).alias("proof_sha256"),
        "folded_root", "verified")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings")) \
        .withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


def op13_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_index.nearest_neighbours(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0) \
        .select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score", "recall")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_embeddings": op2_embeddings,
    "op3_bpe": op3_bpe,
    "op4_toxicity": op4_toxicity,
    "op5_pii": op5_pii,
    "op6_suffix": op6_suffix,
    "op7_secrets": op7_secrets,
    "op8_topk": op8_topk,
    "op9_minhash": op9_minhash,
    "op10_packing": op10_packing,
    "op11_merkle": op11_merkle,
    "op12_whitening": op12_whitening,
    "op13_ann": op13_ann,
}

_SPACE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

ORACLE: dict[str, str] = {
    "op1_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (SELECT *, translate(trim(line, {_SPACE}), {_UPPER}) AS k FROM lines),
owner AS (
  SELECT k, min(doc_id) AS o FROM keyed WHERE length(k) >= 10
  GROUP BY k HAVING count(DISTINCT doc_id) > 1)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE o IS NOT NULL AND o <> doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE o IS NULL OR o = doc_id), '')) AS kept_sha256
FROM keyed LEFT JOIN owner USING (k) GROUP BY doc_id""",
    "op8_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.w, c.w) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10""",
    "op11_merkle": merkle_sql(),
}
