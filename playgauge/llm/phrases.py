"""Phrase collocations by relational mining of occurrences, level by level (SETM).

Texts are split into pieces, and pieces into words. ``R_k`` is the relation of occurrences of frequent k-word phrases:
language, piece, position, phrase. From ``R_k``, sorted by piece and position and written down, each level

1. merge-joins it with itself by piece and adjacent position: a phrase of k + 1 words is frequent only if both phrases
   that it overlaps by all but one word are;
2. counts the groups of the join by language and phrase, over the whole table;
3. semi-joins the join with the frequent groups, which gives ``R_(k+1)``.

The relation is kept in chunks of about CHUNK_WORDS words of whole documents of one language. A chunk is one row: a
number for each position (of a phrase of the chunk's own list; -1 for none), with positions of different pieces never
adjacent. For step 2 chunks send each of their groups once, as a hash of the phrase and a count, dealt to parts by the
hash; a part adds up and tells each chunk by one bit for each of its groups which are frequent. Phrases of equal hash
share a sum, so this keeps too many at most; what it keeps is counted again by the phrase itself, and no result rests
on a hash. Nothing is broadcast, and a phrase or language that holds all rows adds one entry a chunk. A chunk and a part
exchange one row, and never more rows than groups; parts are LEAST_PARTS, or more where these would get too large.

Nulls and unusual input: a null text is empty; a null language is ``und``; ids aren't read, so null or repeated
ones are documents of their own. A long text is cut into words whole and stays in one chunk. An empty table, or one
without candidates, gives no rows. Columns beside lang and text are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playgauge.llm.common import hand_back, mixed, short_batches, stored, text_bytes, thrifty, word_hashes

#: Words after which a chunk is closed, and bytes of text that are cut into words in one step.
CHUNK_WORDS = 1 << 16
STEP = 1 << 20
#: Chunks' words of all languages that a task holds; beyond, the largest is closed early.
HELD_WORDS = 1 << 18
#: Parts of the count at least, and words of the table to one part at most.
LEAST_PARTS = 64
PART_WORDS = 1 << 24

#: ``at``: a number for each position, little-endian 32-bit; ``phrases`` and ``counts`` (occurrences) by number.
RELATION = "chunk long, lang string, at binary, phrases array<string>, counts array<long>"

# Signs between pieces and, with them, between words.
BETWEEN_PIECES = b".,;:!?\n\x0b\x0c\r"
BETWEEN_WORDS = BETWEEN_PIECES + b" \t"


@dataclass(frozen=True)
class Mining:
    """Least occurrences, most words, share (in hundredths) of a phrase's occurrences inside a longer one from which
    on it is dropped, factor of the score, and how many phrases of a language are reported."""

    least: int = 30
    words: int = 4
    inside: int = 80
    factor: int = 2_000_000
    top: int = 2000


_PIECE_END = np.isin(np.arange(256), list(BETWEEN_PIECES))
_WORD_END = np.isin(np.arange(256), list(BETWEEN_WORDS))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _words(raw: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words of texts on end, A-Z lower-cased; the text of each, and whether it follows the one before in its piece."""
    apart = np.append(_WORD_END[raw], True)
    apart_before = np.append(True, apart[:-1])
    apart_before[offsets[:-1]] = True
    apart_after = apart.copy()
    starts = np.flatnonzero(~apart & apart_before)
    last = np.zeros(len(raw) + 1, dtype=bool)
    last[:-1] = apart_after[1:]
    last[offsets[1:][offsets[1:] > 0] - 1] = True
    ends = np.flatnonzero(~apart & last) + 1
    places = np.append(0, np.cumsum(ends - starts))
    kept = _LOWER[raw[~apart[:-1]]]
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(kept))
    owner = np.searchsorted(offsets, starts, "right") - 1
    # The piece of a word: signs between pieces, and texts, before it.
    breaks = np.append(0, np.cumsum(_PIECE_END[raw]))[starts]
    follows = np.zeros(len(starts), dtype=bool)
    follows[1:] = (breaks[1:] == breaks[:-1]) & (owner[1:] == owner[:-1])
    return words, owner, follows


def _relation(chunk: int, lang: str, at: np.ndarray, phrases: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    whole = pa.array([0, len(phrases)], pa.int32())
    columns = [
        pa.array([chunk], pa.int64()),
        pa.array([lang], pa.string()),
        pa.array([at.astype("<i4").tobytes()], pa.binary()),
        pa.ListArray.from_arrays(whole, phrases.cast(pa.string())),
        pa.ListArray.from_arrays(whole, pa.array(counts, pa.int64())),
    ]
    return pa.RecordBatch.from_arrays(columns, ["chunk", "lang", "at", "phrases", "counts"])


def _first_chunk(chunk: int, lang: str, held: list[tuple[pa.Array, np.ndarray]]) -> pa.RecordBatch:
    """All words of a chunk, from its parts' words and whether each follows the one before in its piece."""
    words = pa.concat_arrays([w for w, _ in held]).dictionary_encode()
    follows = np.concatenate([f for _, f in held])
    numbers = words.indices.to_numpy()
    # Between pieces a position stays empty.
    places = np.arange(len(numbers)) + np.cumsum(~follows)
    at = np.full(int(places[-1]) + 1, -1, dtype=np.int32)
    at[places] = numbers
    return _relation(chunk, lang, at, words.dictionary, np.bincount(numbers))


def word_occurrences(docs: DataFrame) -> DataFrame:
    """The relation of all words, in chunks."""
    short_batches(docs.sparkSession)

    @thrifty
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, sizes = TaskContext.get().partitionId() << 32, defaultdict(list), Counter()
        for batch in batches:
            raw, offsets = text_bytes(batch.column("text"))
            names = batch.column("lang").dictionary_encode()
            lang = names.indices.to_numpy()
            a = 0
            while a < len(lang):
                b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + STEP, "right")) - 1)
                words, owner, follows = _words(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                of = lang[a + owner]
                for code in np.unique(of).tolist():
                    own, name = np.flatnonzero(of == code), names.dictionary[code].as_py()
                    held[name].append((words.take(pa.array(own)), follows[own]))
                    sizes[name] += len(own)
                full = [name for name, n in sizes.items() if n >= CHUNK_WORDS]
                while full or sizes.total() > HELD_WORDS:
                    name = full.pop() if full else sizes.most_common(1)[0][0]
                    yield _first_chunk(chunk, name, held.pop(name))
                    chunk += 1
                    del sizes[name]
                a = b
        for name, parts in held.items():
            yield _first_chunk(chunk, name, parts)
            chunk += 1

    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(cut, RELATION)


_NOWHERE = np.zeros(256, dtype=bool)


class Joined:
    """Groups of one chunk: its own, or (``adjacent``) those of its merge-join with itself by adjacent position."""

    def __init__(self, row, parts: int, adjacent: bool):
        self.row, self.adjacent = row, adjacent
        self.at = np.frombuffer(row["at"][0].as_buffer(), dtype="<i4")
        self.phrases = row["phrases"][0].values
        hashes = word_hashes(self.phrases, _NOWHERE)[0]
        if adjacent:
            there = self.at >= 0
            self.place = np.flatnonzero(there[:-1] & there[1:])
            pairs = self.at[self.place].astype(np.int64) * len(self.phrases) + self.at[self.place + 1]
            found, self.numbers, self.counts = np.unique(pairs, return_inverse=True, return_counts=True)
            self.left, self.right = np.divmod(found, max(1, len(self.phrases)))
            hashes = mixed(hashes[self.left] * np.uint64(0x9E3779B97F4A7C15) + hashes[self.right])
        else:
            self.place = np.flatnonzero(self.at >= 0)
            self.numbers = self.at[self.place]
            self.counts = row["counts"][0].values.to_numpy()
        hashes = mixed(hashes ^ word_hashes(pa.array([row["lang"][0].as_py() + "."]), _NOWHERE)[0])
        self.keys = hashes.astype(np.uint32)
        part = ((hashes >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
        #: Groups in order of their parts, and where each part that has any begins.
        self.order = np.argsort(part, kind="stable")
        self.parts, self.begins = np.unique(part[self.order], return_index=True)
        self.ends = np.append(self.begins[1:], len(part))

    def frequent(self, told: dict[int, bytes]) -> pa.RecordBatch | None:
        """The chunk of R_(k+1): occurrences of groups whose bit is set in what their part has told."""
        kept = np.zeros(len(self.keys), dtype=bool)
        for part, a, b in zip(self.parts.tolist(), self.begins.tolist(), self.ends.tolist()):
            if part in told:
                bits = np.unpackbits(np.frombuffer(told[part], dtype=np.uint8), count=b - a)
                kept[self.order[a:b]] = bits.astype(bool)
        if not kept.any():
            return None
        renumbered = np.where(kept, np.cumsum(kept) - 1, -1)
        at = np.full(len(self.at), -1, dtype=np.int32)
        at[self.place] = renumbered[self.numbers]
        if self.adjacent:
            last = pc.replace_substring_regex(self.phrases.take(pa.array(self.right[kept])), r"^.*\x20", "")
            phrases = pc.binary_join_element_wise(self.phrases.take(pa.array(self.left[kept])), last, " ")
        else:
            phrases = self.phrases.filter(pa.array(kept))
        return _relation(self.row["chunk"][0].as_py(), self.row["lang"][0].as_py(), at, phrases, self.counts[kept])


def _frequent(relation: DataFrame, parts: int, least: int, adjacent: bool) -> DataFrame:
    """R_1 from all words or, ``adjacent``, R_(k+1) from R_k."""

    @thrifty
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = Joined(batch.slice(i, 1), parts, adjacent)
                counts = own.counts[own.order].astype("<u4")
                cuts = list(zip(own.begins.tolist(), own.ends.tolist()))
                keys = own.keys[own.order].astype("<u4")
                columns = [
                    pa.array(own.parts, pa.int64()),
                    pa.array([batch.column("chunk")[i].as_py()] * len(cuts), pa.int64()),
                    pa.array([keys[a:b].tobytes() for a, b in cuts], pa.binary()),
                    pa.array([counts[a:b].tobytes() for a, b in cuts], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["part", "of", "keys", "counts"])

    def add(part: pa.Table) -> pa.Table:
        blobs = [np.frombuffer(x.as_buffer(), dtype="<u4") for x in part["keys"]]
        keys, numbers = np.unique(np.concatenate(blobs), return_inverse=True)
        counts = np.concatenate([np.frombuffer(x.as_buffer(), dtype="<u4") for x in part["counts"]])
        enough = (np.bincount(numbers, counts, len(keys)) >= least)[numbers]
        ends = np.cumsum([len(x) for x in blobs])
        bits = [np.packbits(enough[b - len(x) : b]).tobytes() for x, b in zip(blobs, ends.tolist())]
        told = pa.table({"part": part["part"], "of": part["of"], "bits": pa.array(bits, pa.binary())})
        hand_back()
        return told.filter(pa.array([any(x) for x in bits]))

    def keep(row: pa.Table, told: pa.Table) -> pa.Table:
        out = None
        if row.num_rows and told.num_rows:
            out = Joined(row, parts, adjacent).frequent(dict(zip(told["part"].to_pylist(), told["bits"].to_pylist())))
        if out is None:
            out = _relation(0, "", np.zeros(0), pa.array([], pa.string()), np.zeros(0, np.int64)).slice(0, 0)
        hand_back()
        return pa.Table.from_batches([out])

    sent = relation.mapInArrow(send, "part long, of long, keys binary, counts binary")
    told = sent.groupBy("part").applyInArrow(add, "part long, of long, bits binary")
    return relation.groupBy("chunk").cogroup(told.groupBy("of")).applyInArrow(keep, RELATION)


def levels(docs: DataFrame, how: Mining = Mining()) -> tuple[DataFrame, list[DataFrame]]:
    """Words of each language (lang, n) and, from one word to ``how.words``, its frequent phrases (lang, phrase, f)."""
    relation, out = stored(word_occurrences(docs), "words"), []
    size = F.aggregate("counts", F.lit(0).cast("long"), lambda a, n: a + n)
    total = stored(relation.groupBy("lang").agg(F.sum(size).alias("n")), "totals")
    words = total.agg(F.sum("n")).first()[0] or 0
    parts = max(LEAST_PARTS, -(-words // PART_WORDS))
    for k in range(1, how.words + 1):
        relation = stored(_frequent(relation, parts, how.least, k > 1), f"occurrences-{k}")
        # Counted by the phrase itself, not by its hash.
        listed = relation.select("lang", F.inline(F.arrays_zip("phrases", "counts")))
        exact = listed.groupBy("lang", F.col("phrases").alias("phrase")).agg(F.sum("counts").alias("f"))
        out.append(stored(exact.where(F.col("f") >= how.least), f"phrases-{k}"))
    return total, out


def _part(first: int, count: int) -> Column:
    """``count`` words of a phrase from word ``first`` on."""
    return F.array_join(F.slice("words", first, count), " ")


def collocations(docs: DataFrame, how: Mining = Mining()) -> DataFrame:
    """The best phrases of two words or more of each language: lang, rank, phrase, a, l, r, n, score."""
    total, found = levels(docs, how)
    counts = reduce(DataFrame.unionByName, found)
    phrases = reduce(DataFrame.unionByName, [f.withColumn("size", F.lit(k)) for k, f in enumerate(found[1:], 2)])
    phrases = phrases.withColumn("words", F.split("phrase", " "))
    cuts = reduce(
        DataFrame.unionByName,
        [
            phrases.where(F.col("size") > k).select(
                "lang", "phrase", F.col("f").alias("a"), F.lit(k).alias("k"), _part(1, k).alias("first"), F.expr(f"array_join(slice(words, {k + 1}, size - {k}), ' ')").alias("rest")
            )
            for k in range(1, how.words)
        ],
    )
    for side, name in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side])
    # 128-bit decimals: the product may pass 64 bits.
    score = F.expr(f"CAST({how.factor} AS DECIMAL(12, 0)) * CAST(a AS DECIMAL(20, 0)) DIV CAST(l + r AS DECIMAL(20, 0))").cast("long")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # The most occurrences of a longer phrase around each phrase.
    longer = [
        phrases.where(F.col("size") == size).select("lang", F.col("f").alias("around"), F.explode(F.array(*(_part(i, n) for n in range(2, size) for i in range(1, size - n + 2)))).alias("phrase"))
        for size in range(3, how.words + 1)
    ]
    if longer:
        around = reduce(DataFrame.unionByName, longer).groupBy("lang", "phrase").agg(F.max("around").alias("around"))
        scored = scored.join(around, ["lang", "phrase"], "left")
        scored = scored.where(F.col("around").isNull() | (F.col("around") * 100 < F.col("a") * how.inside))
    best = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = scored.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn("rank", F.row_number().over(best).cast("long"))
    return ranked.where(F.col("rank") <= how.top).join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
