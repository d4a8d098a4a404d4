"""A training-data pipeline over ``documents``: each stage keeps, edits or packs what the one before kept.

Stages but the last return the columns of ``documents``; further columns of the input are dropped. Every stage
takes any rows, none included: nulls, repeats and empty texts are treated as its operator's module says.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playgauge.llm import mixing, ngram_join, packing, pii, toxicity
from playgauge.llm.common import scratch, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels of documents at hand, doesn't reject."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    docs = docs.select(*COLUMNS)
    return toxicity.toxicity(docs, labels).where("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates."""
    return ngram_join.deduplicated(docs.select(*COLUMNS))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with its personal data replaced by the kind of it."""
    docs = docs.select(*COLUMNS)
    done = pii.redacted(docs, pii.fit(docs))
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them as a whole: not at all, once or twice."""
    return mixing.mixed_documents(docs.select(*COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces, each with its sequence and offset."""
    return packing.packed(docs.select(*COLUMNS))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("personal-data", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can't express the learned stages. `tests/llm/test_pipeline.py` holds the first four stages, each over the documents,
#: against plain Python with the operators' own scores, spans and readings; `test_contracts.py` does so for packing.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents, each stage's rows written and read again.

    What a stage wrote down for itself goes when its rows are written; what the last one wrote stays for its reader.
    """
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch() as made:
            docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
            made.remove(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
