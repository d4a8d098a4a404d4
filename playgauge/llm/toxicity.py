"""Toxicity scores by logistic regression, learned with FTRL-proximal steps over hashed n-grams.

A text's features are its bare words, word pairs and pairs with one word between (skip-grams), each
present or not, hashed to ``2**bits`` coordinates. Training rows are dealt to shards of
bounded size; each shard takes per-coordinate FTRL steps with an L1 penalty, and the shards' weights are
averaged. What is left is a short list of non-zero weights, which every task can hold.

Nulls and unusual input: a null or empty text scores the prior. A null ``doc_id`` is in no held-out
part and meets no label. Repeated labels of a document count once, as toxic if any of them is. Without labels the
prior is ``EMPTY_PRIOR``. Further columns pass through; ones named like the results are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playgauge.llm.common import NOT_ALNUM, extended, hand_back, mixed, short_batches, thrifty, word_hashes

#: Score of every text when there is nothing to learn from.
EMPTY_PRIOR = 0.02


@dataclass(frozen=True)
class Ftrl:
    """Training parameters.

    ``max_rows`` bounds the labelled rows learned from (sampled by hash); a shard has about
    ``shard_rows`` of them and takes ``steps`` steps or more. Coordinates that fewer than
    ``least_rows`` rows of a shard have are left out.
    """

    bits: int = 20
    alpha: float = 0.7
    beta: float = 1.0
    l1: float = 2.5
    l2: float = 0.01
    least_rows: int = 3
    steps: int = 1_500
    shard_rows: int = 3_000
    max_rows: int = 18_000


@dataclass(frozen=True)
class ToxicityModel:
    """Non-zero weights by coordinate, and the log-odds of a text without any of them."""

    bits: int
    offset: float
    at: np.ndarray
    weight: np.ndarray


_SALT = np.array([0x51ED270B7F4A7C15, 0x2545F4914F6CDD1D, 0x9FB21C651E98DF25], dtype=np.uint64)


def features(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates of the words, pairs and skip-grams of each text, and the text each belongs to."""
    words, starts = word_hashes(texts, NOT_ALNUM)
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    parts, owners = [mixed(words ^ _SALT[0])], [owner]
    for apart in (1, 2):
        same = owner[apart:] == owner[:-apart]
        joined = words[:-apart] * np.uint64(0x9E3779B97F4A7C15) + words[apart:]
        parts.append(mixed(joined ^ _SALT[apart])[same])
        owners.append(owner[apart:][same])
    return (np.concatenate(parts) >> np.uint64(64 - bits)).astype(np.int64), np.concatenate(owners)


def _ftrl(texts: list[str], labels: np.ndarray, offset: float, p: Ftrl) -> tuple[np.ndarray, np.ndarray]:
    """Weights after FTRL-proximal steps over the rows in order, again and again for ``p.steps`` rows at least."""
    size = 1 << p.bits
    z, n, seen = np.zeros(size), np.zeros(size), np.zeros(size, dtype=np.int32)

    def rows() -> Iterator[tuple[int, np.ndarray]]:
        for begin in range(0, len(texts), 256):
            at, owner = features(pa.array(texts[begin : begin + 256], pa.string()), p.bits)
            keys = np.unique((owner << p.bits) | at)
            at, cuts = keys & (size - 1), np.searchsorted(keys >> p.bits, np.arange(257))
            for row in range(min(256, len(texts) - begin)):
                yield begin + row, at[cuts[row] : cuts[row + 1]]

    def weights(at: np.ndarray) -> np.ndarray:
        part = z[at]
        shrunk = np.sign(part) * np.maximum(np.abs(part) - p.l1, 0)
        return -shrunk / ((p.beta + np.sqrt(n[at])) / p.alpha + p.l2)

    for _, own in rows():
        seen[own] += 1
    for _ in range(max(1, -(-p.steps // max(1, len(texts))))):
        for row, own in rows():
            own = own[seen[own] >= p.least_rows]
            w = weights(own)
            margin = min(max(offset + w.sum(), -35.0), 35.0)
            gradient = 1 / (1 + math.exp(-margin)) - labels[row]
            root = np.sqrt(n[own])
            n[own] += gradient * gradient
            z[own] += gradient - (np.sqrt(n[own]) - root) / p.alpha * w
    every = np.flatnonzero(np.abs(z) > p.l1)
    return every, weights(every)


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from training: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, params: Ftrl = Ftrl()) -> ToxicityModel:
    """Learn from the labelled rows that aren't held out, at most about ``params.max_rows`` of them."""
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.max(F.col("toxic").cast("int")).alias("label"))
    )
    total = known.agg(F.count("*").alias("n"), F.sum("label").alias("toxic")).first()
    if not total["n"]:
        return ToxicityModel(params.bits, math.log(EMPTY_PRIOR / (1 - EMPTY_PRIOR)), np.zeros(0, np.int64), np.zeros(0))
    expected = min(total["n"], params.max_rows)
    shards = max(1, round(expected / params.shard_rows))
    share = (total["toxic"] + 1) / (total["n"] + 2 / EMPTY_PRIOR)
    offset = math.log(share / (1 - share))
    order = F.xxhash64("doc_id", F.lit(9))
    bound = int(min(1.0, params.max_rows / total["n"]) * 1_000_000)
    chosen = F.pmod(order, F.lit(1_000_000)) < bound
    rows = (
        docs.select("doc_id", "text").where(chosen & ~held_out())
        .join(known.where(chosen), "doc_id")
        .select(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(shards)).alias("shard"), order.alias("place"), "text", "label")
    )

    def learn(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["place", "text"], na_position="first")
        at, w = _ftrl(part["text"].tolist(), part["label"].to_numpy(), offset, params)
        hand_back()
        return pd.DataFrame({"at": at, "w": w})

    fitted = (
        rows.groupBy("shard").applyInPandas(learn, "at long, w double")
        .groupBy("at").agg((F.sum("w") / shards).alias("w")).orderBy("at")
        .toPandas()  # at most 2**bits weights, whatever the input
    )
    return ToxicityModel(params.bits, offset, fitted["at"].to_numpy(np.int64), fitted["w"].to_numpy(np.float64))


def score(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3) -> DataFrame:
    """All columns of the documents, with ``score`` (0 to 1) and ``predicted`` (1 from the threshold on)."""
    short_batches(docs.sparkSession)
    docs = docs.drop("score", "predicted")

    @thrifty
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(1 << model.bits)
        dense[model.at] = model.weight
        for batch in batches:
            at, owner = features(batch.column("text"), model.bits)
            hit = dense[at] != 0
            pairs = np.unique((owner[hit] << model.bits) | at[hit])
            sums = np.bincount(pairs >> model.bits, dense[pairs & ((1 << model.bits) - 1)], batch.num_rows)
            p = 1 / (1 + np.exp(-np.clip(sums + model.offset, -35, 35)))
            columns = [*batch.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "score", "predicted"])

    return docs.mapInArrow(apply, extended(docs.schema, "score double, predicted int"))


def toxicity(docs: DataFrame, labels: DataFrame, params: Ftrl = Ftrl(), threshold: float = 0.3) -> DataFrame:
    """Train on the labels that may be used, then score every document."""
    return score(docs, train(docs, labels, params), threshold)
