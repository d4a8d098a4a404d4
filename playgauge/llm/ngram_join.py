"""Near-duplicate classes of texts by the Jaccard similarity of their word n-gram sets, exactly.

A text's set is its distinct n-word shingles; with fewer words, the whole sequence is its one shingle. Texts
of equal sets are one class. Classes are linked where their sets' similarity is ``percent`` hundredths or
more, and the result names the component of each document.

1. A text of whose shingles more than a similar one may lack are in no other text is linked with nothing. One pass
   sends a share of each text's shingles, as numbers of 40 bits in pieces of many texts, to parts by ranges of numbers;
   a part tells each piece how many of each text's numbers nothing else has. The texts proven alone are done.
2. The others, one for each class, send all their shingles in the same way, and get the number of texts that have each.
   The order of shingles by that, then number, is the global order: rare shingles come first. Two similar sets share
   a shingle of the beginnings of their ordered sets and are of similar size, so only classes that chains of such
   ties join are ever compared. Shingles that only one text has tie nothing and go no further.
3. Such groups of classes are dealt to tasks with their texts, large ones in blocks that meet pairwise. Each
   task stores the whole ordered sets in a prefix tree and walks it: overlaps of common beginnings are counted
   once, subtrees that can't reach the bound are cut off, and sets already in one component are left alone.

Copies are folded into their class before anything is compared, and tasks give one row per class and block,
not pairs. Nothing is capped: blocks only bound what meets in one task. Sets are compared by 64-bit shingle
hashes, classes by 63 bits of a digest of the set. Shingles of equal number only seem less rare than they are, which
may keep texts for the next step that it could have done without.

Nulls and unusual input: a text without words, or null, has an empty set and is linked with nothing. A null
``doc_id`` never names a component unless all its documents' ids are null. Repeated rows are documents of one class.
An empty table gives an empty result. Other columns, whatever their names, come back from ``deduplicated`` as they were.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from playgauge.llm.common import field, gram_hashes, hand_back, mixed, short_batches, stored, thrifty, word_hashes
from playgauge.llm.components import components
from playgauge.llm.trie import allowed, join_sets

#: Bits of the table of wanted rows, which tells those surely not wanted.
KEY_BITS = 26
_KEY_PARTS = 64
_BIT = np.array([1 << i for i in range(8)], dtype=np.uint8)
#: Bits of a shingle's number, and of what a text is in its piece.
NUMBER_BITS, OWNER_BITS = 40, 16
#: The share of numbers first sent, of all texts: enough for texts of which two thirds are their own. A text of which
#: less is proven its own goes on to the second step, whatever share this is.
FIRST_SHARE = 0.375
#: Numbers of one piece, parts of the count at least, and numbers to one part at most, about.
PIECE_NUMBERS = 1_000_000
LEAST_PARTS = 64
PART_NUMBERS = 4_000_000
#: Shingles of one block of a group of classes.
BLOCK_SHINGLES = 1_500_000


def _sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text, ascending."""
    words, begins = word_hashes(texts)
    grams, begins = gram_hashes(words, begins, n, whole_if_short=True)
    for a, b in zip(begins[:-1].tolist(), begins[1:].tolist()):
        yield np.unique(grams[a:b])


def _present(df: DataFrame, column: str) -> bytes:
    """A bit for each of 2**KEY_BITS buckets: whether a 64-bit hash of the column falls in it. Compressed."""
    size = 1 << KEY_BITS

    @thrifty
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = np.zeros(size // 8, dtype=np.uint8)
        for batch in batches:
            at = _bucket(batch.column(column), size)
            np.bitwise_or.at(there, at >> 3, _BIT[at & 7])
        if there.any():
            parts = [zlib.compress(x.tobytes(), 1) for x in there.reshape(_KEY_PARTS, -1)]
            yield pa.RecordBatch.from_arrays([pa.array(range(_KEY_PARTS), pa.int32()), pa.array(parts, pa.binary())], ["part", "bits"])

    @thrifty
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, data in zip(batch.column("part").to_pylist(), batch.column("bits").to_pylist()):
                sums[part] = sums.get(part, 0) | np.frombuffer(zlib.decompress(data), dtype=np.uint8)
        if sums:
            bits = [zlib.compress(x.tobytes(), 1) for x in sums.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(bits, pa.binary())], ["part", "bits"])

    parts = df.select(column).mapInArrow(mark, "part int, bits binary")
    total = np.zeros((_KEY_PARTS, size // 8 // _KEY_PARTS), dtype=np.uint8)
    # One bit per bucket at most, whatever the input.
    found = parts.repartition(_KEY_PARTS, "part").mapInArrow(add, "part int, bits binary").toArrow()
    for part, data in zip(found["part"].to_pylist(), found["bits"].to_pylist()):
        total[part] = np.frombuffer(zlib.decompress(data), dtype=np.uint8)
    return zlib.compress(total.tobytes(), 1)


def _bucket(keys: pa.Array, size: int) -> np.ndarray:
    return (mixed(keys.to_numpy(zero_copy_only=False).view(np.uint64)) % np.uint64(size)).astype(np.int64)


def _wanted(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Documents but for most whose ``row_key`` is not among those of ``rows``; those stay where they are."""
    present = docs.sparkSession.sparkContext.broadcast(_present(rows.select("row_key"), "row_key"))

    @F.pandas_udf("boolean")
    def may_be(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bits = np.frombuffer(zlib.decompress(present.value), dtype=np.uint8)
        for keys in batches:
            at = _bucket(pa.array(keys), len(bits) * 8)
            yield pd.Series(bits[at >> 3] & _BIT[at & 7] > 0)

    return docs.where(may_be("row_key"))


def _classes(docs: DataFrame, n: int) -> DataFrame:
    """Per document: ``node`` (its class; null for an empty set) and size of the set."""

    @thrifty
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [(_node(grams) if len(grams) else None, len(grams)) for grams in _sets(batch.column("text"), n)]
            nodes, sizes = zip(*sets) if sets else ((), ())
            columns = [batch.column("doc_id"), batch.column("text_key"), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "node", "n_shingles"])

    return docs.mapInArrow(describe, "doc_id long, text_key long, node long, n_shingles long")


#: A row for each part of a piece: its numbers, ascending and written as differences, and the place of each one's text in
#: the piece. One of the rows, which may be without numbers, has the classes and sizes of the piece's texts.
PIECE = "piece long, part int, nodes binary, sizes binary, numbers binary, owners binary"


def _written(values: np.ndarray, start: int) -> bytes:
    """Ascending numbers as differences, the lowest bytes of all first, without those that are 0 in all."""
    steps = np.diff(values, prepend=np.uint64(start)).astype("<u8").view(np.uint8).reshape(-1, 8).T
    width = 1 + max(np.flatnonzero(steps.any(axis=1)).tolist(), default=0) if len(values) else 0
    return steps[:width].tobytes()


def _read(data: bytes, n: int, start: int) -> np.ndarray:
    steps = np.zeros((n, 8), dtype=np.uint8)
    if n:
        steps[:, : len(data) // n] = np.frombuffer(data, dtype=np.uint8).reshape(-1, n).T
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64) + np.uint64(start)


def _starts(parts: int, share: float) -> list[int]:
    """The first number of each part, and the one after the last."""
    limit = int((1 << NUMBER_BITS) * share)
    return [limit * i // parts for i in range(parts + 1)]


def _pieces(docs: DataFrame, n: int, parts: int, share: float) -> DataFrame:
    """The numbers of each text's shingles in the lowest ``share`` of numbers, by piece and part."""
    starts = _starts(parts, share)
    cuts = np.array(starts, dtype=np.uint64) << np.uint64(OWNER_BITS)

    def piece(number: int, nodes: list[int], sizes: list[int], held: list[np.ndarray]) -> pa.RecordBatch:
        lengths = [len(x) for x in held]
        owners = np.repeat(np.arange(len(held), dtype=np.uint64), lengths)
        keys = np.sort((np.concatenate(held) << np.uint64(OWNER_BITS)) | owners)
        at = np.searchsorted(keys, cuts)
        home = number % parts
        some = [i for i in range(parts) if at[i] < at[i + 1] or i == home]
        values, owners = keys >> np.uint64(OWNER_BITS), keys.astype("<u2")
        columns = [
            pa.array([number] * len(some), pa.int64()),
            pa.array(some, pa.int32()),
            pa.array([np.array(nodes, dtype="<i8").tobytes() if i == home else None for i in some], pa.binary()),
            pa.array([np.array(sizes, dtype="<i4").tobytes() if i == home else None for i in some], pa.binary()),
            pa.array([_written(values[at[i] : at[i + 1]], starts[i]) for i in some], pa.binary()),
            pa.array([owners[at[i] : at[i + 1]].tobytes() for i in some], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["piece", "part", "nodes", "sizes", "numbers", "owners"])

    @thrifty
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Counted in the upper half, so that tasks' first pieces have different home parts.
        number = TaskContext.get().partitionId()
        nodes, sizes, held, filled = [], [], [], 0
        for batch in batches:
            for grams in _sets(batch.column("text"), n):
                if not len(grams):
                    continue
                values = grams >> np.uint64(64 - NUMBER_BITS)
                held.append(values[: np.searchsorted(values, np.uint64(starts[-1]))])
                nodes.append(_node(grams))
                sizes.append(len(grams))
                filled += len(held[-1])
                if filled >= PIECE_NUMBERS or len(held) >> OWNER_BITS:
                    yield piece(number, nodes, sizes, held)
                    number += 1 << 32
                    nodes, sizes, held, filled = [], [], [], 0
        if held:
            yield piece(number, nodes, sizes, held)

    return docs.select("text").mapInArrow(cut, PIECE)


def _numbers(rows: pa.Table, starts: list[int]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The numbers, and the place of the text of each, of rows of parts and pieces."""
    owners = [np.frombuffer(x, dtype="<u2") for x in rows["owners"].to_pylist()]
    each = zip(rows["numbers"].to_pylist(), owners, rows["part"].to_pylist())
    return [_read(x, len(own), starts[part]) for x, own, part in each], owners


def _texts(piece: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The classes and sizes of a piece's texts."""
    head = pc.index(piece["nodes"].is_valid(), True).as_py()
    return np.frombuffer(piece["nodes"][head].as_py(), dtype="<i8"), np.frombuffer(piece["sizes"][head].as_py(), dtype="<i4")


def _repeated(numbers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers that occur more than once, ascending, and how often they do."""
    every = np.sort(np.concatenate(numbers))
    ends = np.flatnonzero(np.append(every[1:] != every[:-1], True))
    times = np.diff(ends, prepend=-1)
    return every[ends[times > 1]], times[times > 1]


def _times(values: np.ndarray, repeated: np.ndarray, times: np.ndarray) -> np.ndarray:
    out = np.ones(len(values), dtype=np.int64)
    if len(repeated):
        at = np.minimum(np.searchsorted(repeated, values), len(repeated) - 1)
        hit = repeated[at] == values
        out[hit] = times[at[hit]]
    return out


def _not_alone(docs: DataFrame, n: int, percent: int, parts: int) -> DataFrame:
    """Classes (``node``) but for those with more numbers that nothing else has than a similar set could lack.

    All shingles of equal numbers count, those of one text and of copies too, so that fewer are found alone.
    """
    starts = _starts(parts, FIRST_SHARE)

    def count(part: pa.Table) -> pa.Table:
        numbers, owners = _numbers(part, starts)
        repeated, times = _repeated(numbers)
        single = [np.bincount(own[_times(x, repeated, times) == 1]) for x, own in zip(numbers, owners)]
        # Of one text and part 255 are told at most, which finds fewer alone.
        told = pa.array([np.minimum(x, 255).astype(np.uint8).tobytes() for x in single], pa.binary())
        hand_back()
        return part.select(["piece", "nodes", "sizes"]).append_column("single", told)

    def judge(piece: pa.Table) -> pa.Table:
        nodes, sizes = _texts(piece)
        single = np.zeros(len(nodes), dtype=np.int64)
        for told in piece["single"].to_pylist():
            told = np.frombuffer(told, dtype=np.uint8)
            single[: len(told)] += told
        most = np.array([allowed(size, percent) for size in sizes.tolist()], dtype=np.int64)
        return pa.table({"node": pa.array(nodes[single <= most], pa.int64())})

    told = _pieces(docs, n, parts, FIRST_SHARE).groupBy("part").applyInArrow(count, "piece long, nodes binary, sizes binary, single binary")
    return told.groupBy("piece").applyInArrow(judge, "node long")


def _beginnings(docs: DataFrame, n: int, percent: int, parts: int) -> DataFrame:
    """``token``, ``node`` and size of the set ``n``: of each set's beginning what some other set has, too.

    The beginning is as many of the first shingles, in the global order, as a similar set could all lack, and one.
    """
    starts = _starts(parts, 1)

    def count(part: pa.Table) -> pa.Table:
        numbers, _ = _numbers(part, starts)
        repeated, times = _repeated(numbers)
        levels = pa.array([_levels(_times(x, repeated, times)).tobytes() for x in numbers], pa.binary())
        hand_back()
        return part.append_column("levels", levels)

    def begin(piece: pa.Table) -> pa.Table:
        nodes, sizes = _texts(piece)
        numbers, owners = _numbers(piece, starts)
        levels = [np.frombuffer(x, dtype=np.uint8) for x in piece["levels"].to_pylist()]
        numbers, owners, levels = map(np.concatenate, (numbers, owners, levels))
        order = np.lexsort((numbers, levels, owners))
        numbers, owners, levels = numbers[order], owners[order], levels[order]
        most = np.array([allowed(size, percent) for size in sizes.tolist()], dtype=np.int64)
        first = np.searchsorted(owners, np.arange(len(nodes)))
        kept = (np.arange(len(owners)) - first[owners] <= most[owners]) & (levels > 0)
        own = owners[kept]
        hand_back()
        return pa.table(
            {
                "token": pa.array(numbers[kept].astype(np.int64)),
                "node": pa.array(nodes[own].astype(np.int64)),
                "n": pa.array(sizes[own].astype(np.int32)),
            }
        )

    rated = _pieces(docs, n, parts, 1).groupBy("part").applyInArrow(count, PIECE + ", levels binary")
    return rated.groupBy("piece").applyInArrow(begin, "token long, node long, n int")


def _levels(times: np.ndarray) -> np.ndarray:
    """Counts on a logarithmic scale of one byte: 0 for one, more for more."""
    return np.minimum(255, np.ceil(8 * np.log2(times))).astype(np.uint8)


def _node(grams: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "little") >> 1


def _groups(tokens: DataFrame, percent: int) -> DataFrame:
    """``node`` and ``root`` of classes that chains of shared tokens join; classes alone are left out.

    ``tokens`` has token, node and size ``n``.

    Among the classes that share a token, ordered by size, neighbours are tied where their sizes allow
    similarity. Any two classes that may be similar are then tied through those between them.
    """
    by_size = Window.partitionBy("token").orderBy("n", "node")
    tied = tokens.select("node", "n", F.lag("node").over(by_size).alias("other"), F.lag("n").over(by_size).alias("m"))
    tied = tied.where(F.col("m") * 100 >= F.col("n") * percent)
    return components(tied.select(F.col("node").alias("u"), F.col("other").alias("v")))


def _joined(texts: DataFrame, n: int, percent: int) -> DataFrame:
    """``node`` and ``root`` within each group and pair of blocks, for classes with anything linked to them.

    ``texts`` has group, first, second (blocks), block, node, text.
    """

    @thrifty
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("group", "first", "second"))))
            rows = zip(keys, batch.column("block").to_pylist(), batch.column("node").to_pylist(), _sets(batch.column("text"), n))
            for now, block, node, grams in rows:
                if now != key:
                    yield from _block(key, held, percent)
                    key, held = now, []
                # Another text may have the same key as the class's own.
                if _node(grams) == node and not (held and held[-1][1] == node):
                    held.append((block, node, grams))
        yield from _block(key, held, percent)

    return texts.mapInArrow(walk, "node long, root long")


def _block(key, held: list, percent: int) -> Iterator[pa.RecordBatch]:
    """Links within one block, or across two."""
    if len(held) < 2:
        return
    # Places in an order by how many of these sets have a shingle replace the hashes: rare ones come first.
    every, times = np.unique(np.concatenate([grams for *_, grams in held]), return_counts=True)
    place = np.empty(len(every), dtype=np.int32)
    place[np.argsort(times, kind="stable")] = np.arange(len(every), dtype=np.int32)
    _, first, second = key
    split = {True: [], False: []}
    for block, node, grams in held:
        split[block == first].append((node, np.sort(place[np.searchsorted(every, grams)])))
    rows = split[True] + split[False]
    left, right = [s for _, s in split[True]], [s for _, s in split[False]]
    own = join_sets(left, None if first == second else right, percent)
    found = [(rows[i][0], rows[c][0]) for i, c in enumerate(own) if c != i]
    if found:
        nodes, roots = zip(*found)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(roots, pa.int64())], ["node", "root"])


def _parts(df: DataFrame, size: str, share: float) -> int:
    """How many parts to count the ``share`` of the sets' shingles in."""
    shingles = df.agg(F.sum(size)).first()[0] or 0
    return max(LEAST_PARTS, -(-int(shingles * share) // PART_NUMBERS))


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, text_key (hash of its text), n_shingles, component_id and ``kept``.

    ``component_id`` is the smallest id in the document's component. ``kept`` marks one row of each
    component, and every row of an empty set.
    """
    spark = docs.sparkSession
    short_batches(spark)
    docs = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.xxhash64("text").alias("text_key"),
    )
    docs = docs.withColumn("row_key", F.xxhash64("doc_id", "text_key"))
    described = stored(_classes(docs.drop("row_key"), n), "classes")
    # One row, and one text, stands for each class.
    nodes = described.where("node IS NOT NULL").groupBy("node").agg(
        F.min(F.struct("doc_id", "text_key")).alias("one"), F.first("n_shingles").alias("n")
    )
    parts = _parts(described, "n_shingles", FIRST_SHARE)
    left = nodes.join(_not_alone(docs, n, percent, parts).distinct(), "node")
    left = stored(left.withColumn("row_key", F.xxhash64("one.doc_id", "one.text_key")), "not-alone")
    groups = _groups(_beginnings(_wanted(docs, left), n, percent, _parts(left, "n", 1)), percent)
    members = left.drop("row_key").join(groups, "node")
    # Members by size, in blocks of bounded shingles; a block meets itself and those of similar size.
    upto = Window.partitionBy("root").orderBy("n", "node")
    members = members.withColumn("block", F.floor((F.sum("n").over(upto) - F.col("n")) / BLOCK_SHINGLES))
    blocks = members.groupBy("root", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    meets = (F.col("a.root") == F.col("b.root")) & (F.col("a.block") <= F.col("b.block"))
    pairs = blocks.alias("a").join(blocks.alias("b"), meets & (F.col("a.high") * 100 >= F.col("b.low") * percent))
    pairs = pairs.select(
        F.col("a.root").alias("group"),
        F.col("a.block").alias("first"),
        F.col("b.block").alias("second"),
        F.explode(F.array_distinct(F.array("a.block", "b.block"))).alias("block"),
    )
    on = (F.col("m.root") == F.col("p.group")) & (F.col("m.block") == F.col("p.block"))
    dealt = members.alias("m").join(pairs.alias("p"), on).select("p.*", "m.node", "m.one")
    dealt = stored(dealt, "dealt")
    docs = _wanted(docs, dealt.select(F.xxhash64("one.doc_id", "one.text_key").alias("row_key")))
    same = (F.col("d.text_key") == F.col("x.one.text_key")) & F.col("d.doc_id").eqNullSafe(F.col("x.one.doc_id"))
    texts = docs.alias("d").join(dealt.alias("x"), same).select("x.group", "x.first", "x.second", "x.block", "x.node", "d.text")
    by = ["group", "first", "second"]
    links = _joined(texts.repartition(*by).sortWithinPartitions(*by, "block", "node"), n, percent)
    # A group of one block is finished; blocks' links of one group are joined up.
    links = components(links.select(F.col("node").alias("u"), F.col("root").alias("v")))
    of = described.select("doc_id", "text_key", "node", "n_shingles").join(links, "node", "left")
    of = of.withColumn("root", F.coalesce("root", "node"))
    least = of.where("node IS NOT NULL").groupBy("root").agg(
        F.min("doc_id").alias("component_id"),
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("keeper"),
    )
    out = of.join(least, "root", "left")
    kept = F.col("node").isNull() | F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key").eqNullSafe(F.col("keeper"))
    return out.select(
        "doc_id",
        "text_key",
        "n_shingles",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        kept.alias("kept"),
    )


def deduplicated(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The documents, one of each component; all documents without words stay."""
    # By the same columns, none of them null, documents are joined and repeated rows numbered: texts are dealt out once.
    keys = ["text_key", "id", "no_id"]

    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumns({"id": F.coalesce("doc_id", F.lit(0).cast("long")), "no_id": F.col("doc_id").isNull()}).drop("doc_id")

    kept = near_duplicates(docs, n, percent).where("kept").select("doc_id", "text_key", (F.col("n_shingles") == 0).alias("bare"))
    kept = keyed(kept).groupBy(*keys).agg(F.first("bare").alias("bare"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_key"))
    rows = keyed(rows).join(kept, keys)
    # Rows repeated in id and text: the first by the other plain columns stands for them.
    plain = [field(f.name) for f in docs.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType))]
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64(*plain)))
    return rows.withColumn("first", first).where("bare OR first = 1").select(*map(field, docs.columns))
