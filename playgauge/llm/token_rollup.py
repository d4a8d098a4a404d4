"""Token totals by source, language and tokenizer version, kept up to date by signed changes.

A change is +1 document with its tokens (insert), -1 (delete), or both for a new count of a document. Only
sums of changes are stored: each commit writes its batch's sums in a folder of its own and then names it in a log.
Of a batch committed twice the later counts, and what a failed commit left behind doesn't. Totals are sums over
batches, so the documents are never counted again, and batches may arrive in any order.

Nulls and unusual input: null sources and languages are groups of their own; a null text has no tokens.
Repeated rows are changes like others. A group that all its documents have left is not listed. Batches of an empty
table are committed like others and add nothing; ``totals`` of a folder without any commit fails, as nothing is there.
Long texts are counted whole, in place. Columns beside source, lang and text are kept only where ``also`` names them.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a token is, by tokenizer version.
VERSIONS = {
    "words-1": r"[^\x20\x09-\x0D]+",
    "words-2": r"[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]",
}
KEYS = ["source", "lang", "version"]
CHANGES = "source string, lang string, version string, docs long, tokens long"


def tokens(version: str, text: str = "text") -> Column:
    """Number of a version's tokens in a text."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(VERSIONS[version])).cast("long"), F.lit(0).cast("long"))


def ledger(docs: DataFrame, *versions: str) -> DataFrame:
    """One narrow row per document: doc_id, source, lang and ``counts``, its tokens under each version.

    Kept by whoever commits changes, it takes the place of the texts in ``counted`` and ``revised``: a document that
    leaves, or is counted anew, isn't read again.
    """
    counts = F.struct(*(tokens(v).alias(v) for v in versions)).alias("counts")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), counts)


def _tokens(rows: DataFrame, version: str) -> Column:
    """From a ledger's row, or from the text."""
    return F.col("counts").getField(version) if "counts" in rows.columns else tokens(version)


def counted(docs: DataFrame, version: str, sign: int = 1, *also: str) -> DataFrame:
    """One change per document (or row of a ledger), in or out; ``also`` names columns to keep beside it."""
    return docs.select(
        *also,
        F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"),
        F.lit(version).alias("version"),
        F.lit(sign).cast("long").alias("docs"),
        (_tokens(docs, version) * sign).alias("tokens"),
    )


def revised(docs: DataFrame, old: str, new: str) -> DataFrame:
    """Two changes per document (or row of a ledger), whose count under the old version gives way to the new one's."""
    both = F.explode(
        F.array(
            F.struct(F.lit(old).alias("version"), F.lit(-1).cast("long").alias("docs"), (-_tokens(docs, old)).alias("tokens")),
            F.struct(F.lit(new).alias("version"), F.lit(1).cast("long").alias("docs"), _tokens(docs, new).alias("tokens")),
        )
    )
    return docs.select("source", "lang", both.alias("c")).select("source", "lang", "c.version", "c.docs", "c.tokens")


def commit(folder: str, batch: int, changes: DataFrame) -> None:
    """Store a batch's sums, then name them in the log, which makes them count.

    Sums go to a folder of their own, never over others, and a commit that dies before its row is in the log
    leaves files that nobody reads. Committing a batch again adds a later row, and the latest counts alone.
    Fits ``foreachBatch`` of a stream as ``lambda changes, batch: commit(folder, batch, changes)``.
    """
    attempt = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    sums = changes.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
    sums.write.parquet(f"{folder}/sums/batch={int(batch)}/attempt={attempt}")
    _log(changes.sparkSession, folder, int(batch), attempt)


def _log(spark: SparkSession, folder: str, batch: int, attempt: str) -> None:
    row = spark.range(1, numPartitions=1).select(F.lit(batch).cast("long").alias("batch"), F.lit(attempt).alias("attempt"))
    row.write.mode("append").parquet(f"{folder}/log")


def totals(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and tokens of every group that still has any, by the log's latest attempt of each batch."""
    log = spark.read.schema("batch long, attempt string").parquet(f"{folder}/log")
    latest = log.groupBy("batch").agg(F.max("attempt").alias("attempt"))
    sums = spark.read.schema(f"{CHANGES}, batch long, attempt string").parquet(f"{folder}/sums")
    return (
        sums.join(latest, ["batch", "attempt"], "left_semi")
        .groupBy(*KEYS)
        .agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
        .where("n_docs <> 0 OR n_tokens <> 0")
    )
