"""Corpus pipeline: raw documents to packed training sequences.

Each stage is one operator of ``domus.llm`` over all that the stage before it
kept; all but the last return the columns of ``documents``.  Null texts and
null ids pass through (see the operators), an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from domus.llm import line_dedup, minhash, packing, pii, toxicity
from domus.llm.common import cut, read, tokenizer_path


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` as the changed text has it."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) \
        if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples don't call toxic."""
    return toxicity.drop_toxic(docs, read(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document holds."""
    return _counted(line_dedup.dedup_lines(docs, counts=False))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, on five-word shingles."""
    return minhash.keep_one_of_each(docs, width=5, percent=80)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by the name of its kind."""
    return _counted(pii.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place in a sequence of 2048 tokens."""
    return packing.pack_documents(docs, tokenizer_path).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("minhash", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("packing", pack),
]

# The toxicity model and the tokenizer are beyond SQL; tests/llm compares each
# stage with a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
