"""Fill-in-middle transformation: each text's prefix, middle and suffix, told apart and put in another order.

A text's units are its words, each with the ASCII white space before it; white space at the end is a unit of its
own. Two cuts between units are drawn from a hash of the seed and the document's id, and so is the form: ``plain``
(the text as it is), ``psm`` (prefix, suffix, middle) or ``spm`` (suffix, prefix, middle).

Units are never listed. The UTF-8 bytes of a text are viewed as 64-bit words, padded with spaces; sums and masks
that carry over no byte mark the byte that ends each unit; ``bitwise_count`` counts the marks of a word, and a
running sum of the counts finds, by binary search, the word in which a wanted unit ends. There the lower marks are
cleared one by one. Continuation bytes are marked and counted alike, which turns byte places to code points.

Nulls and unusual input: a null text is empty, and an empty text is plain with no units. A text that contains a
sentinel is plain, so that every output can be undone. A null ``doc_id`` is hashed as empty digits. Rows repeated
in id and text give equal rows. Long texts are worked on whole, alone in their step. An empty table gives an empty
result. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playgauge.llm.common import short_batches, text_bytes, thrifty

_U = np.uint64
_HIGH, _LOW = _U(0x8080808080808080), _U(0x7F7F7F7F7F7F7F7F)
#: Bytes of text worked on in one step; a longer text is a step of its own.
STEP = 4 << 20


@dataclass(frozen=True)
class Infill:
    """Seed of the draws, sentinels, and how many in a hundred texts are transformed, and of these go suffix first."""

    seed: int = 42
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    transformed: int = 50
    suffix_first: int = 80


def _at_least(low: np.ndarray, byte: int) -> np.ndarray:
    """High bit of each byte of ``low`` (all below 128) that is ``byte`` or more."""
    return low + _U((0x80 - byte) * 0x0101010101010101)


def spaces(words: np.ndarray) -> np.ndarray:
    """High bit of each byte that is a space or one of the five control characters 9 to 13."""
    low = words & _LOW
    control = _at_least(low, 0x09) & ~_at_least(low, 0x0E)
    blank = _at_least(low, 0x20) & ~_at_least(low, 0x21)
    return (control | blank) & ~words & _HIGH


def continuations(words: np.ndarray) -> np.ndarray:
    """High bit of each byte that continues a UTF-8 character: its two upper bits are 1 and 0."""
    return words & (~words << _U(1)) & _HIGH


class Marked:
    """Unit ends of several texts on end, by words of eight bytes."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.sizes = np.diff(offsets)
        count = self.sizes // 8 + 1  # one byte of padding at least
        self.first = np.cumsum(count) - count
        padded = np.full(int(count.sum()) * 8, 0x20, dtype=np.uint8)
        for at, a, b in zip((self.first * 8).tolist(), offsets[:-1].tolist(), offsets[1:].tolist()):
            padded[at : at + b - a] = raw[a:b]
        words = padded.view("<u8")
        blank = spaces(words)
        # A unit ends at a byte that isn't white space before one that is.
        following = blank >> _U(8)
        following[:-1] |= blank[1:] << _U(56)
        following[-1:] |= _U(0x80 << 56)
        self.marks = following & ~blank & _HIGH
        # White space at the end of a text is a unit too.
        last = self.first * 8 + self.sizes - 1
        blank_end = np.flatnonzero((self.sizes > 0) & (blank[last // 8] >> (last % 8 * 8 + 7).astype(_U) & _U(1)).astype(bool))
        self.marks[last[blank_end] // 8] |= _U(0x80) << (last[blank_end] % 8 * 8).astype(_U)
        self.upto = self._running(self.marks)
        self.more = continuations(words)
        self.more_upto = self._running(self.more)
        self.units = self.upto[self.first + count] - self.upto[self.first]

    @staticmethod
    def _running(marks: np.ndarray) -> np.ndarray:
        """Marks before each word, and all of them."""
        out = np.zeros(len(marks) + 1, dtype=np.int64)
        np.cumsum(np.bitwise_count(marks), out=out[1:])
        return out

    def ends(self, k: np.ndarray) -> np.ndarray:
        """Bytes of each text up to the end of its first ``k`` units."""
        wanted = self.upto[self.first] + k
        word = np.searchsorted(self.upto, wanted, "left") - 1
        some = k > 0
        word = np.where(some, word, 0)
        marks = self.marks[word].copy() if len(self.marks) else np.zeros(len(k), dtype=_U)
        lower = np.where(some, wanted - self.upto[word] - 1, 0)
        for n in range(7):
            marks = np.where(lower > n, marks & (marks - _U(1)), marks)
        byte = np.bitwise_count((marks & (~marks + _U(1))) - _U(1)).astype(np.int64) >> 3
        return np.where(some, (word - self.first) * 8 + byte + 1, 0)

    def chars(self, ends: np.ndarray) -> np.ndarray:
        """Code points of each text in its first ``ends`` bytes."""
        word = self.first + ends // 8
        below = (_U(1) << (ends % 8 * 8).astype(_U)) - _U(1)
        continued = self.more_upto[word] - self.more_upto[self.first] + np.bitwise_count(self.more[word] & below)
        return ends - continued.astype(np.int64)


def _steps(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about STEP bytes together."""
    a = 0
    while a < len(offsets) - 1:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + STEP, "right")) - 1)
        yield a, b
        a = b


def infilled(docs: DataFrame, how: Infill = Infill()) -> DataFrame:
    """One row per document: doc_id, n (units), form, prefix_chars, middle_chars (null if plain), output."""
    short_batches(docs.sparkSession)
    sentinels = [s.encode() for s in (how.prefix, how.suffix, how.middle)]
    p, s, m = sentinels

    @thrifty
    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_bytes(batch.column("text"))
            h1, h2, h3, h4 = (batch.column(f"h{i}").to_numpy() for i in range(1, 5))
            for a, b in _steps(offsets):
                marked = Marked(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                n = marked.units
                one, two = h1[a:b] % (n + 1), h2[a:b] % (n + 1)
                cut, end = marked.ends(np.minimum(one, two)), marked.ends(np.maximum(one, two))
                before, upto = marked.chars(cut), marked.chars(end)
                form, output, plain = [], [], np.zeros(b - a, dtype=bool)
                for i, (x, y) in enumerate(zip(cut.tolist(), end.tolist())):
                    text = raw[offsets[a + i] : offsets[a + i + 1]].tobytes()
                    if not text or h3[a + i] % 100 >= how.transformed or any(sign in text for sign in sentinels):
                        plain[i] = True
                        form.append("plain")
                        output.append(text)
                    elif h4[a + i] % 100 < how.suffix_first:
                        form.append("spm")
                        output.append(b"".join((s, text[y:], p, text[:x], m, text[x:y])))
                    else:
                        form.append("psm")
                        output.append(b"".join((p, text[:x], s, text[y:], m, text[x:y])))
                columns = [
                    batch.column("doc_id").slice(a, b - a),
                    pa.array(n, pa.int64()),
                    pa.array(form, pa.string()),
                    pa.array(before, pa.int64(), mask=plain),
                    pa.array(upto - before, pa.int64(), mask=plain),
                    pa.array(output, pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    digest = F.sha2(F.concat(F.lit(f"{how.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    drawn = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), digest.alias("digest"))
    draws = [F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    return drawn.select("doc_id", "text", *draws).mapInArrow(
        transform, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    )


def restored(output: Column | str = "output", form: Column | str = "form", how: Infill = Infill()) -> Column:
    """The text that an output of the given form was made from."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))

    def between(sentinel: str, upto: str | None) -> Column:
        begin = F.locate(sentinel, output) + len(sentinel)
        length = F.length(output) if upto is None else F.locate(upto, output) - begin
        return F.substr(output, begin, length)

    psm = F.concat(between(how.prefix, how.suffix), between(how.middle, None), between(how.suffix, how.middle))
    spm = F.concat(between(how.prefix, how.middle), between(how.middle, None), between(how.suffix, how.prefix))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
