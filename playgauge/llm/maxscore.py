"""Exact top-k by inner product with MaxScore, over shards of vectors.

A vector's dimensions are its terms. Within a shard each term's contribution to a query's score lies between
bounds known from the shard's least and greatest value; what exceeds the lower bound is the term's posting.
Terms whose upper bounds together can't lift a vector over the query's current threshold are non-essential:
essential terms are scored for all of the shard's vectors, the others only for vectors that stay competitive,
and these are dropped as the bounds of what is left to probe shrink. The shards' best are merged.

Vectors are dealt to shards and queries to blocks, both of bounded size; every block meets every shard once.

Nulls and unusual input: vectors that are null, or hold null or non-finite components, take no part; neither do
rows of null id. Vectors of different lengths meet in the dimensions both have. Repeated ids are rows of their
own. Scores that don't fit a long raise an error. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS = 8_192
BLOCK_QUERIES = 4_096
#: Essential terms are scored for so many at a time before bounds are looked at again.
PROBE_TERMS = 8


def scaled(vector: str = "embedding", factor: float = 256.0) -> Column:
    """floor(factor * x) of each component, or null where the vector takes no part."""
    good = F.col(vector).isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    )
    return F.when(good, F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(factor)).cast("long")))


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for row, vector in zip(out, vectors):
        row[: min(width, len(vector))] = vector[:width]
    return out


def top_of_shard(query: np.ndarray, query_id: int, ids: np.ndarray, docs: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the shard that are the query's ``k`` best, ties to smaller ids, and their scores."""
    lower = np.minimum(query * low, query * high)
    bound = np.maximum(query * low, query * high) - lower  # of the postings' contributions
    terms = np.argsort(-bound, kind="stable")
    rest = np.append(np.cumsum(bound[terms][::-1])[::-1], 0)  # bound of all terms from here on
    alive = np.flatnonzero(ids != query_id)
    if not len(alive):
        return alive, np.zeros(0)
    base = lower.sum()
    # A first threshold: the k-th best of some of the vectors, scored in full.
    sample = alive[:: max(1, len(alive) // 64)]
    known = docs[sample] @ query
    threshold = np.partition(known, len(known) - k)[len(known) - k] if len(known) >= k else -np.inf
    # Essential terms: without them no vector could reach the threshold.
    essential = int(np.searchsorted(-(base + rest), -threshold, "right"))
    essential = min(max(essential, 1), len(terms))
    own = terms[:essential]
    part = np.zeros(len(query))
    part[own] = query[own]
    score = (docs @ part)[alive] + (base - lower[own].sum())
    at = essential
    while at < len(terms):
        keep = score + rest[at] >= threshold
        if not keep.all():
            alive, score = alive[keep], score[keep]
        own = terms[at : at + PROBE_TERMS]
        score = score + docs[np.ix_(alive, own)] @ query[own] - lower[own].sum()
        at += len(own)
    order = np.lexsort((ids[alive], -score))[:k]
    return alive[order], score[order]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of each query's best vectors but itself.

    Both sides have ``vec_id`` and ``v``, an array of longs.
    """
    vectors = vectors.where("vec_id IS NOT NULL AND v IS NOT NULL").select("vec_id", "v")
    queries = queries.where("vec_id IS NOT NULL AND v IS NOT NULL").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    shards = max(1, -(-vectors.count() // SHARD_ROWS))
    blocks = max(1, -(-queries.count() // BLOCK_QUERIES))
    stored = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards))).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    )
    asked = queries.withColumn("block", F.pmod(F.xxhash64("query_id", "q"), F.lit(blocks)).cast("int")).withColumn(
        "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))
    )

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "vec_id", "score"]
        if not len(left) or not len(right):
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in columns})
        width = min(left["v"].map(len).max(), right["q"].map(len).max())
        docs, asked_for = _matrix(left["v"], width), _matrix(right["q"], width)
        # Whole numbers are exact in doubles up to 2**53.
        most = np.abs(docs).max(initial=0) * np.abs(asked_for).max(initial=0) * max(width, 1)
        exact = most < 2.0**52
        ids, low, high = left["vec_id"].to_numpy(), docs.min(axis=0), docs.max(axis=0)
        out = []
        for query_id, row, whole in zip(right["query_id"], asked_for, right["q"]):
            if exact:
                rows, scores = top_of_shard(row, query_id, ids, docs, low, high, k)
                scores = scores.astype(np.int64)
            else:
                every = [(-sum(int(a) * int(b) for a, b in zip(whole, v)), i, at) for at, (v, i) in enumerate(zip(left["v"], ids)) if i != query_id]
                best = sorted(every)[:k]
                rows, scores = [at for *_, at in best], [-s for s, *_ in best]
            out.append(pd.DataFrame({"query_id": query_id, "vec_id": ids[rows], "score": scores}))
        return pd.concat(out).astype("int64")

    best = (
        stored.groupBy("shard", F.col("block").cast("int").alias("block"))
        .cogroup(asked.groupBy("shard", "block"))
        .applyInPandas(search, "query_id long, vec_id long, score long")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
