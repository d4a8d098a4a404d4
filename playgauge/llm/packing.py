"""Packing token pieces into sequences by vector best fit.

A text's ids, with an end mark after them, are cut only where they exceed a sequence: into pieces of full
length, the first of which may be shorter. A sequence has three capacities: tokens, pieces, and attention cost
(the sum of squared piece lengths). Pieces, largest first by weighted norm, go to the open sequence that has
room in all three and is left with the least weighted norm of what remains; else a new one is opened.

Ids are made once, in the pass over the texts; only lengths and check sums are shuffled. Pieces are dealt by
hash to groups of about ``group_rows``, and each group is packed by itself. A group leaves about one sequence
unfilled, whatever its size.

Nulls and unusual input: a null text is empty, and an empty text is the end mark alone. Null or repeated
``doc_id`` values are documents of their own. An empty table gives no pieces. Columns beside doc_id and text
are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playgauge.llm.common import short_batches, stored, thrifty, worker_state
from playgauge.llm.tokens import Words


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds. The defaults for pieces and cost never bind: tokens alone imply them."""

    tokens: int = 1024
    pieces: int = 1024
    cost: int = 1024 * 1024
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)


@dataclass(frozen=True)
class Vocabulary:
    """Files of the tokenizer and of the same vocabulary as ranks, its word pattern and the end mark's id."""

    path: str = public_tokenizers.path("byte_bpe_50k.json")
    ranks_path: str = public_tokenizers.path("byte_bpe_50k.tiktoken")
    pattern: str = public_tokenizers.PATTERN
    end: int = 2


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, spot long"


def pieces(docs: DataFrame, tokens: int = 1024, vocabulary: Vocabulary = Vocabulary()) -> DataFrame:
    """One row per piece: its place in the document's ids, their CRC-32, and a running number in its task."""
    short_batches(docs.sparkSession)

    @thrifty
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, spot = worker_state(), 0
        if vocabulary not in kept:
            kept[vocabulary] = Words(vocabulary.path, vocabulary.ranks_path, vocabulary.pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids, begins = kept[vocabulary].encode(texts)
            # The end mark after each text.
            ids = np.insert(ids, begins[1:], vocabulary.end).astype("<u4")
            begins = begins + np.arange(len(begins))
            size = np.diff(begins)
            number = np.maximum(1, -(-size // tokens))
            owner = np.repeat(np.arange(len(texts)), number)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)
            lead = size - (number - 1) * tokens
            start = np.where(piece == 0, 0, lead[owner] + (piece - 1) * tokens)
            length = np.where(piece == 0, lead[owner], tokens)
            at = begins[owner] + start
            view = memoryview(ids.tobytes())
            crc = [zlib.crc32(view[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(owner)),
                    pa.array(piece.astype(np.int32)),
                    pa.array(start),
                    pa.array(length),
                    pa.array(crc, pa.int64()),
                    pa.array(spot + np.arange(len(owner))),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32", "spot"],
            )
            spot += len(owner)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECES)


def best_fit(length: np.ndarray, capacity: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """Number of the sequence of each piece and its offset there; pieces must fit an empty sequence."""
    full = np.array([capacity.tokens, capacity.pieces, capacity.cost], dtype=np.float64)
    scale = np.sqrt(capacity.weights) / full
    need = np.stack([length, np.ones(len(length)), length.astype(np.float64) ** 2])
    order = np.argsort(-((need * scale[:, None]) ** 2).sum(axis=0), kind="stable")
    if (need > full[:, None]).any():
        raise ValueError("a piece exceeds an empty sequence's capacity")
    least = int(length.min()) if len(length) else 0
    bins, offsets = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
    room = np.zeros((3, len(length)))  # of the open sequences, the first `n` columns
    name = np.zeros(len(length), dtype=np.int64)
    n = opened = 0
    for i in order:
        want = need[:, i]
        left = room[:, :n] - want[:, None]
        fits = np.flatnonzero((left >= 0).all(axis=0))
        if len(fits):
            rest = left[:, fits] * scale[:, None]
            at = fits[np.argmin((rest * rest).sum(axis=0))]
        else:
            at, n = n, n + 1
            room[:, at], name[at] = full, opened
            opened += 1
        bins[i], offsets[i] = name[at], capacity.tokens - room[0, at]
        room[:, at] -= want
        if room[0, at] < least or room[1, at] < 1:
            n -= 1
            room[:, at], name[at] = room[:, n], name[n]
    return bins, offsets


def pack(cut: DataFrame, capacity: Capacity = Capacity(), group_rows: int = 16_384) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``."""
    cut = stored(cut, "pieces")
    groups = max(1, -(-cut.count() // group_rows))

    def place(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "doc_id", "start", "ids_crc32", "spot"], ignore_index=True)
        bins, offsets = best_fit(part["length"].to_numpy(), capacity)
        part["sequence_id"] = part["deal"].to_numpy() * (1 << 32) + bins
        part["offset"] = offsets
        return part.drop(columns=["deal", "spot"])

    deal = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "spot"), F.lit(groups))
    return (
        cut.withColumn("deal", deal)
        .groupBy("deal")
        .applyInPandas(
            place,
            "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
        )
    )


def packed(docs: DataFrame, capacity: Capacity = Capacity(), vocabulary: Vocabulary = Vocabulary()) -> DataFrame:
    """The documents' pieces, each with its sequence and offset."""
    return pack(pieces(docs, capacity.tokens, vocabulary), capacity)
