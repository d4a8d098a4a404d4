"""Helpers that several of the text operators share."""

from __future__ import annotations

import ctypes
import functools
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of an Arrow batch handed to Python. Texts may be long, so batches stay short.
ARROW_ROWS = 1000
#: Bytes of one, about; a longer row is a batch of its own.
ARROW_BYTES = 4 << 20
#: Bytes of text hashed in one vectorized step.
STEP_BYTES = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``. Only a local session, whose executors live in the
    driver's process, may go without: it gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="playgauge-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(df: DataFrame, what: str) -> DataFrame:
    """The rows written as Parquet in the shared folder and read again, which cuts the lineage.

    The folder stays until ``discard`` or the end of a ``scratch`` around the call.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    for made in _scratches:
        made.append(out)
    return out


_scratches: list[list[DataFrame]] = []


def discard(df: DataFrame) -> None:
    """Delete a folder that ``stored`` made; nothing may read it any more, a lost task's second run included."""
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(df._stored_at)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def forget(df: DataFrame) -> None:
    """Discard a frame of ``stored`` before the scratch around it ends."""
    for made in _scratches:
        made[:] = [other for other in made if other is not df]
    discard(df)


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Discards at its end what ``stored`` made inside, but for frames taken off the list it gives."""
    made: list[DataFrame] = []
    _scratches.append(made)
    try:
        yield made
    finally:
        _scratches.remove(made)
        for df in made:
            discard(df)


def field(name: str, of: str = "row") -> Column:
    """A column of the input, carried in the struct ``of`` so that it can't clash with a helper column."""
    return F.col(of).getField(name).alias(name)


def extended(schema: T.StructType, ddl: str) -> T.StructType:
    """A copy of the schema with the fields of a DDL string after its own."""
    return T.StructType([*schema.fields, *T.StructType.fromDDL(ddl).fields])


def worker_state() -> dict:
    """What a Python worker keeps from task to task, by name."""
    return sys.modules.setdefault("playgauge_worker_state", ModuleType("playgauge_worker_state")).__dict__


def thrifty(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over a task's batches that hands free memory back to the system when it is done.

    Workers serve task after task. What their allocators keep for later would otherwise count against the
    executor for as long as the session lasts, beside what the next stage needs.
    """

    @functools.wraps(work)
    def batches(found: Iterator) -> Iterator:
        try:
            yield from work(found)
        finally:
            hand_back()

    return batches


def hand_back() -> None:
    """Return free memory of Arrow's and the C library's allocators; the latter only where it can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def short_batches(spark: SparkSession) -> None:
    """Keep Arrow batches short enough for long texts: by rows, and by bytes where texts are long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


_U = np.uint64
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_STEP = 0x9E3779B97F4A7C15
_STEP_INVERSE = pow(_STEP, -1, 1 << 64)
_powers = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}


def _power(way: str, n: int) -> np.ndarray:
    if len(_powers[way]) < n:
        factor = np.full(n, _STEP if way == "up" else _STEP_INVERSE, dtype=np.uint64)
        factor[0] = 1
        _powers[way] = np.cumprod(factor, dtype=np.uint64)
    return _powers[way][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (splitmix64 finalizer)."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts on end and where each begins; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, starts, data = texts.buffers()
    offsets = np.frombuffer(starts, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


#: ASCII characters other than letters and digits, as separators of bare words.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def word_hashes(texts: pa.Array, apart: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, A-Z lower-cased, and where each text's words begin.

    Words are runs of bytes not marked in ``apart``: by default the six ASCII white-space characters.
    """
    raw, offsets = text_bytes(texts)
    size, out, starts_at = len(raw), [], []
    at = 0
    while at < size:
        end = min(at + STEP_BYTES, size)
        while end < size and not apart[raw[end]] and not (offsets == end).any():
            # Move the cut to the next white space or text, in steps.
            ahead = np.flatnonzero(apart[raw[end : end + STEP_BYTES]])
            bound = offsets[np.searchsorted(offsets, end, "right")]
            stop = end + int(ahead[0]) if len(ahead) else min(end + STEP_BYTES, size)
            end = int(min(stop, bound))
        block = raw[at:end]
        inside = ~apart[block]
        inner = offsets[(offsets >= at) & (offsets < end)] - at
        before = np.empty_like(inside)
        before[0] = False
        before[1:] = inside[:-1]
        before[inner] = False
        starts = np.flatnonzero(inside & ~before)
        after = np.empty_like(inside)
        after[-1] = False
        after[:-1] = inside[1:]
        after[inner[inner > 0] - 1] = False
        ends = np.flatnonzero(inside & ~after) + 1
        sums = np.zeros(len(block) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[block] * _power("up", len(block)), out=sums[1:])
        hashed = (sums[ends] - sums[starts]) * _power("down", len(block))[starts]
        out.append(mixed(hashed + (ends - starts).astype(np.uint64)))
        starts_at.append(starts + at)
        at = end
    if not out:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(offsets), dtype=np.int64)
    return np.concatenate(out), np.searchsorted(np.concatenate(starts_at), offsets).astype(np.int64)


_GRAM = np.array([pow(0xD6E8FEB86659FD93, i, 1 << 64) for i in range(32)], dtype=np.uint64)


def gram_hashes(words: np.ndarray, offsets: np.ndarray, n: int, *, whole_if_short: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles of each text, and where each text's shingles begin.

    With ``whole_if_short`` a text of fewer than n words, but some, has its whole sequence as one.
    """
    counts = np.diff(offsets)
    grams = np.maximum(counts - n + 1, 0)
    if whole_if_short:
        grams = np.where((counts > 0) & (counts < n), 1, grams)
    begins = np.concatenate([[0], np.cumsum(grams)]).astype(np.int64)
    first = np.arange(begins[-1]) - np.repeat(begins[:-1], grams) + np.repeat(offsets[:-1], grams)
    length = np.repeat(np.minimum(counts, n), grams)
    h = np.zeros(len(first), dtype=np.uint64)
    for i in range(n):
        if whole_if_short:
            there = i < length
            h[there] += words[first[there] + i] * _GRAM[i]
        else:
            h += words[first + i] * _GRAM[i]
    return mixed(h + length.astype(np.uint64)), begins
