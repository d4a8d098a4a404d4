"""Byte-pair encoding with word ends by forced-boundary splitting, and its decoding.

A merge joins two neighbours to a token of the vocabulary. Two bytes that are neighbours in no token can therefore
never be joined, and a word is sure to be cut between them. The fragments between such cuts are encoded
independently, all of a batch's new ones together on arrays: in each round every fragment joins the pairs of its
least rank, until none is left. Very long fragments take their pairs from a heap instead, one by one. A word's ids are
those of its fragments, and a text's ids those of its words, on end.

Words are cut as the vocabulary's file says: Unicode composition, lower case, then contractions, runs of letters,
single numbers and runs of other signs, with white space dropped. Texts with code points whose class may depend on
the version of Unicode are cut into words by the ``tokenizers`` library's own rules; their words go the same way.

Nulls and unusual input: a null text is empty and has no ids. Names of special tokens in a text are these tokens, as
in the library. Null or repeated ids are documents of their own. Long texts and words are encoded whole. An empty
table gives an empty result. Columns beside doc_id and text (or ids) are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from playgauge.llm.common import short_batches, thrifty, worker_state

#: Words whose ids a worker keeps.
KEPT_WORDS = 200_000
#: Ids of tokens are below this.
_IDS = 1 << 16
_NONE = np.int64(1 << 40)
#: Code points of texts encoded in one step; a longer text is a step of its own.
STEP = 2_000_000
#: Symbols of a fragment from which on its pairs wait in a heap.
LONG = 512

# Word rule, word end and names of the vocabulary's file.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
#: Latin, Greek, Cyrillic, general punctuation and symbols, whose classes are settled, as a class of a pattern.
SETTLED = r"\u0000-\u0377\u037A-\u037F\u0384-\u052F\u1E00-\u1EFF\u2000-\u2064\u20A0-\u20C0\u2100-\u218B\u2190-\u2426\u2460-\u2B73"


@dataclass(frozen=True)
class Vocabulary:
    """The tokenizer's file."""

    path: str = public_tokenizers.path("word_bpe_49k.json")


def byte_signs() -> list[str]:
    """The printable sign that stands for each byte: itself if Latin-1 prints it, else the next from U+0100 on."""
    printed = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    others = iter(range(256, 512))
    return [chr(b if b in printed else next(others)) for b in range(256)]


def _settled_word() -> re.Pattern:
    """The word rule for texts of settled code points, with the classes written out."""
    inside = re.compile(f"[{SETTLED}]")
    found: dict[str, list[int]] = {"L": [], "N": [], "space": [*range(9, 14), 0x20, 0x85, 0xA0, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F]}
    for point in range(0x3000):
        kind = unicodedata.category(chr(point))[0]
        if kind in found and inside.match(chr(point)):
            found[kind].append(point)
    letters, numbers, white = ("".join(rf"\u{p:04x}" for p in points) for points in found.values())
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{white}{letters}{numbers}]+")


class Encoder:
    """One worker's view of a vocabulary, and the ids of words met so far."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        self.path, self.library, self.rank_of = path, None, None
        model = rules["model"]
        vocab: dict[str, int] = model["vocab"]
        if model["end_of_word_suffix"] != WORD_END or rules["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] != WORD:
            raise ValueError("the vocabulary's words are cut by another rule")
        special = {t["content"]: t["id"] for t in rules["added_tokens"]}
        self.tokens = {i: token for token, i in chain(vocab.items(), special.items())}
        if max(self.tokens) >= _IDS:
            raise ValueError(f"ids must be below {_IDS}")
        signs = byte_signs()
        self.byte_id = np.array([vocab[s] for s in signs], dtype=np.int64)
        self.last_byte_id = np.array([vocab[s + WORD_END] for s in signs], dtype=np.int64)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([vocab[a] * _IDS + vocab[b] for a, b in merges], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.joined = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        # Byte pairs that are neighbours in some token; the word end is no byte.
        byte_of = {s: b for b, s in enumerate(signs)}
        self.inside = np.zeros((256, 256), dtype=bool)
        for token in vocab:
            bare = [byte_of[s] for s in token.removesuffix(WORD_END)]
            self.inside[bare[:-1], bare[1:]] = True
        self.special = {name: np.uint32(i).tobytes() for name, i in special.items()}
        self.names = re.compile("(" + "|".join(re.escape(n) for n in sorted(special, key=len, reverse=True)) + ")") if special else None
        self.word = _settled_word()
        self.unsettled = re.compile(f"[^{SETTLED}]")
        self.known: dict[str, bytes] = {}

    def words(self, text: str) -> list[str]:
        """A text's words, as bytes of their own or names of special tokens, in lower case."""
        if self.names and self.names.search(text):
            parts = self.names.split(text)
            # Names stand at odd places; a null sign keeps them apart from words.
            return [w for i, part in enumerate(parts) for w in (["\0" + part] if i % 2 else self._words(part))]
        return self._words(text)

    def _words(self, text: str) -> list[str]:
        if text.isascii():
            return self.word.findall(text.lower())
        # Lower case sign by sign: a sigma at the end of a word is no exception.
        lower = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        if not (self.unsettled.search(text) or self.unsettled.search(lower)):
            return self.word.findall(lower)
        if self.library is None:
            self.library = Tokenizer.from_file(self.path)
            self.byte_of = {s: b for b, s in enumerate(byte_signs())}
        text = self.library.normalizer.normalize_str(text)
        signs = (word for word, _ in self.library.pre_tokenizer.pre_tokenize_str(text))
        return [bytes(map(self.byte_of.__getitem__, word)).decode() for word in signs]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian 32-bit numbers."""
        out, a = [], 0
        while a < len(texts):
            b, size = a + 1, len(texts[a] or "")
            while b < len(texts) and size + len(texts[b] or "") <= STEP:
                size += len(texts[b] or "")
                b += 1
            out += self._encode([self.words(t) if t else [] for t in texts[a:b]])
            a = b
        return out

    def _encode(self, split: list[list[str]]) -> list[bytes]:
        missing = set(chain.from_iterable(split)) - self.known.keys()
        if len(self.known) + len(missing) > KEPT_WORDS:
            self.known, missing = {}, set(chain.from_iterable(split))
        if missing:
            names = [w for w in missing if w[0] == "\0" and w[1:] in self.special]
            self.known.update((w, self.special[w[1:]]) for w in names)
            bare = list(missing.difference(names))
            self.known.update(zip(bare, self.encode_words(bare)))
        return [b"".join(map(self.known.__getitem__, words)) for words in split]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word (none empty), cut into fragments at its sure boundaries."""
        data = [w.encode() for w in words]
        raw = np.frombuffer(b"".join(data), dtype=np.uint8)
        if not len(raw):
            return [b""] * len(words)
        ends = np.cumsum(np.fromiter(map(len, data), np.int64, len(data)))
        symbols = self.byte_id[raw]
        symbols[ends - 1] = self.last_byte_id[raw[ends - 1]]
        # The first byte of every fragment: of a word, or after a pair that no token holds.
        first = np.ones(len(raw), dtype=bool)
        first[1:] = ~self.inside[raw[:-1], raw[1:]]
        first[ends[:-1]] = True
        ids, at = self.merge(symbols, first)
        size = np.bincount(np.searchsorted(ends, at, "right"), minlength=len(words))
        out, view = [], ids.astype("<u4").tobytes()
        begin = 0
        for n in size.tolist():
            out.append(view[begin : begin + 4 * n])
            begin += 4 * n
        return out

    def merge(self, symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all fragments (``first``: where each begins) and the place of each token's first byte."""
        fragment = np.cumsum(first) - 1
        place = np.arange(len(symbols))
        done_ids, done_at = [], []
        begins = np.flatnonzero(first)
        sizes = np.diff(begins, append=len(symbols))
        for k in np.flatnonzero(sizes > LONG):
            ids, at = self._merge_long(symbols[begins[k] : begins[k] + sizes[k]])
            done_ids.append(ids)
            done_at.append(begins[k] + at)
        if done_ids:
            short = np.repeat(sizes <= LONG, sizes)
            symbols, place, fragment = symbols[short], place[short], fragment[short]
        while len(symbols):
            pair = np.full(len(symbols), _NONE)
            open_ = np.flatnonzero(fragment[:-1] == fragment[1:])
            key = symbols[open_] * _IDS + symbols[open_ + 1]
            found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            pair[open_] = np.where(self.keys[found] == key, self.ranks[found], _NONE)
            starts = np.flatnonzero(np.diff(fragment, prepend=-1))
            least = np.repeat(np.minimum.reduceat(pair, starts), np.diff(starts, append=len(symbols)))
            ended = least == _NONE
            if ended.any():
                done_ids.append(symbols[ended])
                done_at.append(place[ended])
                live = ~ended
                symbols, place, fragment, pair, least = (x[live] for x in (symbols, place, fragment, pair, least))
                if not len(symbols):
                    break
            take = pair == least
            # Of overlapping pairs, as in a run of one sign, every second is taken, from the left.
            run = np.flatnonzero(take & ~np.append(False, take[:-1]))
            since = np.arange(len(take)) - np.repeat(np.append(0, run), np.diff(np.concatenate([[0], run, [len(take)]])))
            take &= since % 2 == 0
            at = np.flatnonzero(take)
            symbols[at] = self.joined[pair[at]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[at + 1] = False
            symbols, place, fragment = symbols[keep], place[keep], fragment[keep]
        ids, at = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (done_ids, done_at))
        order = np.argsort(at, kind="stable")
        return ids[order], at[order]

    def _merge_long(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of one fragment, by a heap of its pairs, and the place of each token's first symbol."""
        if self.rank_of is None:
            self.rank_of = dict(zip(self.keys.tolist(), self.ranks.tolist()))
        size, at = len(symbols), symbols.tolist()
        before, after = list(range(-1, size - 1)), list(range(1, size + 1))
        waiting = [(r, i) for i in range(size - 1) if (r := self.rank_of.get(at[i] * _IDS + at[i + 1])) is not None]
        heapify(waiting)
        while waiting:
            rank, i = heappop(waiting)
            j = after[i]
            # The pair may be gone: its left or right symbol joined to another.
            if at[i] < 0 or j >= size or self.rank_of.get(at[i] * _IDS + at[j]) != rank:
                continue
            at[i], at[j] = int(self.joined[rank]), -1
            after[i] = after[j]
            if after[i] < size:
                before[after[i]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] < size:
                    found = self.rank_of.get(at[left] * _IDS + at[after[left]])
                    if found is not None:
                        heappush(waiting, (found, left))
        left = np.array(at, dtype=np.int64)
        kept = np.flatnonzero(left >= 0)
        return left[kept], kept

    def decode(self, ids: bytes) -> str:
        """The tokens' own spelling, parted by spaces, as the library decodes without a decoder."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def _encoder(vocabulary: Vocabulary) -> Encoder:
    kept = worker_state()
    if ("bpe", vocabulary) not in kept:
        kept["bpe", vocabulary] = Encoder(vocabulary.path)
    return kept["bpe", vocabulary]


def coded(docs: DataFrame, vocabulary: Vocabulary = Vocabulary(), decoded: bool = False) -> DataFrame:
    """One row per document: doc_id and ``ids`` (little-endian 32-bit numbers on end); with ``decoded`` also these
    ids' text (``decoded``), in the same pass."""
    short_batches(docs.sparkSession)

    @thrifty
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        for batch in batches:
            ids = encoder.encode(batch.column("text").to_pylist())
            columns = [batch.column("doc_id"), pa.array(ids, pa.binary())]
            if decoded:
                columns.append(pa.array(map(encoder.decode, ids), pa.string()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"][: len(columns)])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(encode, "doc_id long, ids binary" + ", decoded string" * decoded)


def decoded(coded_docs: DataFrame, vocabulary: Vocabulary = Vocabulary()) -> DataFrame:
    """One row per document: doc_id and the text of its ``ids``; null ids are an empty text."""
    short_batches(coded_docs.sparkSession)

    @thrifty
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        for batch in batches:
            texts = [encoder.decode(ids or b"") for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "decoded"])

    return coded_docs.select("doc_id", "ids").mapInArrow(decode, "doc_id long, decoded string")
