"""Secret scans over an incremental blob ledger (DataFrame functions only).

Every text is a version of a blob, addressed by the SHA-256 of its content.
The ledger holds the (blob, rule version) pairs that were scanned and their
findings.  A scan looks up which pairs are missing, reads one text of each
missing blob, and joins findings back to every path that holds the blob.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from domus.llm.common import cut, text_or_empty
from domus.llm.spans import find_spans

KINDS = ("assign", "access", "hex")
RULE_VERSION = "1"

# The three base patterns, with their least lengths folded in
# where a shorter run can hold no match.  Possessive repeats, so that a long
# run takes one pass.
RULES = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]++""",
     (":", "=")),
    ("access", r"AKIA[A-Z0-9]++", ("AKIA",)),
    ("hex", r"(?<![0-9a-f])[0-9a-f]{24,}+", ()),
)
_VALUE = r"""^[A-Za-z_]+["']?\x20*[:=]\x20*["']?(.*)$"""
FINDINGS = "blob string, rule_version string, kind string, start long, end long, value string"


def scan(blobs: DataFrame, rule_version: str = RULE_VERSION) -> DataFrame:
    """Findings (blob, rule_version, kind, start, end, value) of rows (blob, text)."""
    passes = (F.when(F.col("kind") == "assign", F.length(F.regexp_extract("value", _VALUE, 1)) >= 6)
              .when(F.col("kind") == "access", F.length("value") >= 20).otherwise(True))
    return find_spans(blobs, ["blob"], RULES).where(passes) \
        .select("blob", F.lit(rule_version).alias("rule_version"), "kind", "start", "end", "value")


class BlobLedger:
    """Scanned pairs and findings as Parquet under ``path``, one sub-folder a scan."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def seen(self) -> DataFrame:
        return self._read("seen", "blob string, rule_version string")

    def findings(self) -> DataFrame:
        return self._read("findings", FINDINGS).distinct()

    def add(self, versions: DataFrame, rule_version: str = RULE_VERSION) -> None:
        """Scan the blobs of ``versions`` (path_id, blob, text) that this rule
        version hasn't seen.  Findings are written before the pairs are
        marked as seen, so a scan that fails is repeated, not lost."""
        known = self.seen().where(F.col("rule_version") == rule_version).select("blob")
        unseen = versions.groupBy("blob").agg(F.min("path_id").alias("rep"), F.lit(rule_version).alias("rule_version")) \
            .join(known, "blob", "left_anti")
        unseen = cut(unseen, "ledger-unseen")
        reps = unseen.select(F.col("blob").alias("_b"), F.col("rep"))
        texts = versions.join(reps, (versions["blob"] == reps["_b"]) & versions["path_id"].eqNullSafe(reps["rep"]),
                              "left_semi").select("blob", "text")
        scan(texts, rule_version).write.mode("append").parquet(f"{self.path}/findings")
        unseen.select("blob", "rule_version").write.mode("append").parquet(f"{self.path}/seen")


def versions_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(path_id, blob, text): every row as a version of a content-addressed blob."""
    return docs.select(F.col(id_col).alias("path_id"), text_or_empty(text_col).alias("text")) \
        .withColumn("blob", F.sha2(F.col("text").cast("binary"), 256))


def secret_scan(docs: DataFrame, ledger: BlobLedger, id_col: str = "doc_id", text_col: str = "text",
                rule_version: str = RULE_VERSION) -> DataFrame:
    """(path_id, blob, kind, start, end, value): all findings of all rows.

    Null texts count as empty, empty texts have no findings.  A null id is a
    path of its own kind: its rows are returned with a null path_id.
    Repeated rows return their findings each.  Other columns are not read.
    """
    versions = versions_of(docs, id_col, text_col)
    ledger.add(versions, rule_version)
    f = ledger.findings().where(F.col("rule_version") == rule_version)
    return versions.select("path_id", "blob").join(f, "blob").drop("rule_version")
