"""SimHash fingerprints of texts, and all fingerprints within a Hamming radius by permuted block tables.

Every occurrence of a word n-gram votes on each bit with its hash, so a gram weighs as much as it is
frequent in the text. Shorter texts vote with their whole sequence. Fingerprints have 128 bits, written as
32 hexadecimal digits; likeness is the share of equal bits.

``neighbours`` gives the pairs of a few queries; ``near_counts`` counts for many, without a pair leaving its task. A
block value that very many fingerprints share is cut into slices that meet slice by slice.

Nulls and unusual input: a null text is empty; texts without words have the fingerprint of zeros. Null ids
come before others, rows of one id are ordered by text. Columns beside those read are ignored. An empty table gives an
empty result. Very long texts vote in steps of bounded size.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playgauge.llm.common import gram_hashes, hand_back, mixed, short_batches, stored, thrifty, word_hashes

BITS = 128
#: Grams of one vote count, and texts of one step.
STEP_GRAMS = 1 << 16
STEP_TEXTS = 200
#: Ranges of ids at most, whose bounds the driver holds.
MOST_RANGES = 10_000
RANGE_ROWS = 4_000
#: Fingerprints of one block value that meet in one task, rows of a task, and pairs compared in one step.
SLICE = 20_000
DEALT_ROWS = 50_000
STEP_PAIRS = 1 << 20

_SET = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float64)


def fingerprints(texts: pa.Array, n: int = 3) -> np.ndarray:
    """One row of 16 bytes per text."""
    words, begins = word_hashes(texts)
    grams, begins = gram_hashes(words, begins, n, whole_if_short=True)
    count = len(begins) - 1
    out = np.zeros((count, BITS // 8), dtype=np.uint8)
    at = 0
    while at < count:
        end = min(at + STEP_TEXTS, count)
        tally = np.zeros((end - at) * 16 * 256)
        owner = np.repeat(np.arange(end - at), np.diff(begins[at : end + 1]))
        own = grams[begins[at] : begins[end]]
        for a in range(0, len(own), STEP_GRAMS):
            h = own[a : a + STEP_GRAMS]
            bytes_ = np.stack([h, mixed(h ^ np.uint64(0xA5A5A5A5A5A5A5A5))], axis=1).view(np.uint8).reshape(len(h), 16)
            keys = (owner[a : a + STEP_GRAMS, None] * 16 + np.arange(16)) * 256 + bytes_
            tally += np.bincount(keys.ravel(), minlength=len(tally))
        votes = tally.reshape(end - at, 16, 256) @ _SET
        sizes = np.diff(begins[at : end + 1])
        bits = (2 * votes > sizes[:, None, None]).reshape(end - at, BITS)
        out[at:end] = np.packbits(bits, axis=1)
        at = end
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bits, row by row."""
    return 1 - np.bitwise_count(a ^ b).sum(axis=1) / BITS


def fingerprinted(docs: DataFrame, n: int = 3) -> DataFrame:
    """The rows with ``fingerprint``; a column of that name is replaced."""
    short_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def make(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([x.tobytes().hex() for x in fingerprints(pa.array(texts, pa.large_string()), n)])

    return docs.withColumn("fingerprint", make("text"))


def in_order(docs: DataFrame) -> DataFrame:
    """``range``, ``after``, doc_id and text of every document, sorted so within each partition.

    Documents of a range of ids follow each other; ``after`` marks copies of the next range's first
    documents (the first range's, for the last), which end each range. Only those are sent twice.
    """
    rows = docs.count()
    ranges = min(MOST_RANGES, max(1, -(-rows // RANGE_ROWS)))
    at = [i / ranges for i in range(1, ranges)]
    bounds = np.unique(docs.approxQuantile("doc_id", at, 0.1 / ranges) if at else []).astype(np.float64)

    @F.pandas_udf("int")
    def range_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for ids in batches:
            yield pd.Series(np.where(ids.isna(), 0, np.searchsorted(bounds, ids.astype(np.float64), "right"))).astype("int32")

    spread = docs.select("doc_id", "text", range_of("doc_id").alias("range"))
    firsts = spread.groupBy("range").agg(
        F.min("doc_id").alias("first"), F.max(F.col("doc_id").isNull()).alias("bare")
    )
    found = sorted((r["range"], None if r["bare"] else r["first"]) for r in firsts.collect())  # one row per range
    if not found:
        return spread.select("range", F.lit(False).alias("after"), "doc_id", "text")
    before = docs.sparkSession.createDataFrame(
        [(number, first, found[i - 1][0]) for i, (number, first) in enumerate(found)],
        "range int, first long, before int",
    )
    first = F.broadcast(before)  # at most MOST_RANGES rows
    sent = spread.join(first, "range")
    is_first = F.col("doc_id").eqNullSafe(F.col("first"))
    places = F.array(F.struct("range", F.lit(False).alias("after")))
    again = F.when(is_first, F.array(F.struct(F.col("before").alias("range"), F.lit(True).alias("after"))))
    sent = sent.select("doc_id", "text", F.explode(F.concat(places, F.coalesce(again, F.array().cast("array<struct<range:int,after:boolean>>")))).alias("p"))
    return (
        sent.select("p.range", "p.after", "doc_id", "text")
        # Ranges follow the numbers of their tasks, so none share one by chance.
        .repartitionById(found[-1][0] + 1, "range")
        .sortWithinPartitions("range", "after", F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    )


EDITED = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def edited_likeness(docs: DataFrame, share: int = 4, n: int = 3) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness to each other and the next text.

    The edited text has its last ``n_chars // share`` code points replaced by as many of the beginning of the
    next document in order of id, or all of it.
    """
    short_batches(docs.sparkSession)
    ordered = in_order(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))

    @thrifty
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last document of the rows so far waits for the one after it.
        now, waiting = None, None
        for batch in batches:
            ids, texts, following = [], [], []
            for number, after, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("range", "after", "doc_id", "text"))):
                text = text or ""
                if number != now:
                    now, waiting = number, None
                if waiting is not None:
                    ids.append(waiting[0])
                    texts.append(waiting[1])
                    following.append(text)
                waiting = None if after else (doc_id, text)
            if ids:
                yield result(ids, texts, following)

    def result(ids: list, texts: list[str], following: list[str]) -> pa.RecordBatch:
        edited = [t[: len(t) - len(t) // share] + f[: len(t) // share] for t, f in zip(texts, following)]
        own, new, other = (fingerprints(pa.array(x, pa.large_string()), n) for x in (texts, edited, following))
        columns = [
            pa.array(ids, pa.int64()),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
            pa.array([x.tobytes().hex() for x in own]),
            pa.array([x.tobytes().hex() for x in new]),
            pa.array(likeness(own, new)),
            pa.array(likeness(own, other)),
        ]
        return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in EDITED.split(", ")])

    return ordered.mapInArrow(compare, EDITED)


def block_keys(fingerprint: str, radius: int, blocks: int) -> Column:
    """A key per table: the digits of the blocks that the table puts first, with the table's number.

    Of ``blocks`` blocks of whole digits at most ``radius`` can differ, so every pair within the radius
    agrees on some choice of ``blocks - radius`` blocks. More blocks make more tables of longer keys.
    """
    if not radius < blocks <= 32:
        raise ValueError("needs more blocks than the radius, 32 at most")
    cuts = [32 * i // blocks for i in range(blocks + 1)]
    parts = [F.substring(fingerprint, a + 1, b - a) for a, b in itertools.pairwise(cuts)]
    tables = itertools.combinations(range(blocks), blocks - radius)
    return F.array(*(F.concat(F.lit(f"{t}:"), *(parts[i] for i in chosen)) for t, chosen in enumerate(tables)))


def distance(a: str, b: str) -> Column:
    """Number of bits in which two fingerprints differ."""
    halves = []
    for at in (1, 9, 17, 25):
        x, y = (F.conv(F.substring(c, at, 8), 16, 10).cast("long") for c in (a, b))
        halves.append(F.bit_count(x.bitwiseXOR(y)))
    return sum(halves[1:], halves[0])


def near_counts(queries: DataFrame, every: DataFrame, radius: int = 3) -> DataFrame:
    """How many different fingerprints lie within the radius of each: ``fingerprint`` and ``n_near``.

    Both sides have ``fingerprint``; equal ones are folded first. There are four tables, one for each 32 bits put first,
    so pairs that differ in up to three bits agree on one at least, and a pair counts in the first table on which it does.
    """
    if not 0 <= radius <= 3:
        raise ValueError("four tables find pairs of at most three different bits")

    def tables(df: DataFrame) -> DataFrame:
        one = df.where("fingerprint IS NOT NULL").select("fingerprint").distinct()
        first = F.array(*(F.conv(F.substring("fingerprint", 8 * t + 1, 8), 16, 10).cast("long") + F.lit(t << 32) for t in range(4)))
        return one.select(F.unhex("fingerprint").alias("bits"), F.explode(first).alias("key"))

    q, s = stored(tables(queries), "near-queries"), stored(tables(every), "near-every")
    dealt = max(1, -(-(q.count() + s.count()) // DEALT_ROWS))
    cuts = [F.ceil(F.col("n") / SLICE).cast("int") for _ in range(2)]
    per = [df.groupBy("key").agg(F.count("*").alias("n")).select("key", cut.alias(name)) for df, cut, name in zip((q, s), cuts, ("q_cuts", "s_cuts"))]
    # Keys of one slice on both sides, nearly all, need no row here.
    hot = per[0].join(per[1], "key").where("q_cuts > 1 OR s_cuts > 1")

    def spread(df: DataFrame, own: str, other: str) -> DataFrame:
        """Rows once in each slice of the other side."""
        df = df.join(hot, "key", "left").withColumns({c: F.coalesce(F.col(c), F.lit(1)) for c in (own, other)})
        mine, theirs = F.pmod(F.xxhash64("bits"), F.col(own)).cast("int"), F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        df = df.select("bits", "key", mine.alias(own), theirs.alias(other))
        return df.select("bits", "key", F.hash("q_cuts", "s_cuts").alias("slice"), F.pmod(F.xxhash64("key", "q_cuts", "s_cuts"), F.lit(dealt)).alias("deal"))

    def count(asked: pa.Table, held: pa.Table) -> pa.Table:
        out = {"bits": pa.array([], pa.binary()), "n": pa.array([], pa.int64())}
        if asked.num_rows and held.num_rows:
            (q_at, q_bits), (s_at, s_bits) = _sorted(asked), _sorted(held)
            # Queries meet the run of their own key and slice.
            a, b = (np.searchsorted(s_at, q_at, side) for side in ("left", "right"))
            total, n = np.zeros(len(q_at), dtype=np.int64), b - a
            upto = np.cumsum(n)
            begin = 0
            while begin < len(n):
                end = max(begin + 1, int(np.searchsorted(upto, upto[begin] - n[begin] + STEP_PAIRS, "right")))
                one = np.repeat(np.arange(begin, end), n[begin:end])
                met = np.arange(len(one)) - np.repeat(np.cumsum(n[begin:end]) - n[begin:end], n[begin:end]) + a[one]
                differ = q_bits[one] ^ s_bits[met]
                bits = np.bitwise_count(differ).sum(axis=1)
                here = (differ == 0).argmax(axis=1) == q_at["key"][one] >> 32
                near = one[(bits > 0) & (bits <= radius) & here]
                total += np.bincount(near, minlength=len(n))
                begin = end
            some = np.flatnonzero(total)
            out = {"bits": pa.array([x.tobytes() for x in q_bits[some]], pa.binary()), "n": pa.array(total[some])}
            hand_back()
        return pa.table(out)

    left, right = spread(q, "q_cuts", "s_cuts"), spread(s, "s_cuts", "q_cuts").withColumnRenamed("deal", "to")
    found = left.groupBy("deal").cogroup(right.groupBy("to")).applyInArrow(count, "bits binary, n long")
    found = found.groupBy(F.lower(F.hex("bits")).alias("fingerprint")).agg(F.sum("n").alias("n_near"))
    asked = queries.where("fingerprint IS NOT NULL").select("fingerprint").distinct()
    return asked.join(found, "fingerprint", "left").select("fingerprint", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"))


def _sorted(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Key and slice of the rows, ascending, and their bits as four 32-bit numbers."""
    at = np.empty(rows.num_rows, dtype=[("key", np.int64), ("slice", np.int64)])
    at["key"], at["slice"] = rows["key"].to_numpy(), rows["slice"].to_numpy()
    order = np.argsort(at, order=("key", "slice"), kind="stable")
    bits = np.frombuffer(b"".join(rows["bits"].to_pylist()), dtype=np.uint32).reshape(-1, 4)
    return at[order], bits[order]


def neighbours(queries: DataFrame, stored: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """Different fingerprints within the radius: ``query``, ``fingerprint``, ``distance``.

    Both sides have ``fingerprint``; equal ones are folded first, so groups of copies count once. Join
    the result to the documents by fingerprint.
    """
    q = queries.where("fingerprint IS NOT NULL").select(F.col("fingerprint").alias("query")).distinct()
    s = stored.where("fingerprint IS NOT NULL").select("fingerprint").distinct()
    q = q.withColumn("key", F.explode(block_keys("query", radius, blocks)))
    s = s.withColumn("key", F.explode(block_keys("fingerprint", radius, blocks)))
    found = q.join(s, "key").withColumn("distance", distance("query", "fingerprint"))
    return found.where((F.col("distance") <= radius) & (F.col("query") != F.col("fingerprint"))).drop("key").distinct()
