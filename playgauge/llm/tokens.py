"""Token ids of whole batches of texts by a byte-level BPE vocabulary of the ``tokenizers`` library.

The library spends most of its time on words it has met before. Here a batch is cut into its words
first, by the vocabulary's own pre-tokenization rule on arrays of code points; each different word is
encoded once, from the same vocabulary's ranks, and kept while it is among those that many steps have. Texts with code points outside the plain ranges
below, or with a special token's name in them, go to the library as they are.
"""

from __future__ import annotations

import base64
import itertools
import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from tokenizers import Tokenizer

#: Words whose ids a worker keeps.
KEPT_WORDS = 250_000
#: Code points of texts encoded in one step; a longer text is a step of its own.
STEP = 2_000_000

LETTER, NUMBER, OTHER, SPACE, UNKNOWN = range(5)


def _classes() -> np.ndarray:
    """Class of every code point below 0x3000; Latin, Greek, Cyrillic and general symbols are known."""
    table = np.full(0x3000, UNKNOWN, dtype=np.uint8)
    for point in [*range(0x0530), *range(0x2000, 0x2C00)]:
        kind = unicodedata.category(chr(point))[0]
        table[point] = {"L": LETTER, "N": NUMBER}.get(kind, OTHER)
    # White space by the Unicode property.
    table[[*range(9, 14), 32, 0x85, 0xA0, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F]] = SPACE
    return table


class Words:
    """Encoder of one worker: the library's tokenizer and the ids of words met so far."""

    def __init__(self, path: str, ranks_path: str, pattern: str):
        """``path``: the tokenizer's file. ``ranks_path``: the same vocabulary as base64 tokens and ranks."""
        self.path, self._tokenizer = path, None
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.ranks = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        with open(path, encoding="utf-8") as file:
            self.special = [t["content"] for t in json.load(file)["added_tokens"]]
        self.classes = _classes()
        # Of each known word: the steps it was in, the number of its ids, and the ids on end.
        self.known = pa.array([], pa.large_string())
        self.steps, self.counts = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)
        self.flat = np.zeros(0, dtype=np.uint32)

    @property
    def tokenizer(self) -> Tokenizer:
        """The library's tokenizer, made when a text first needs it."""
        if self._tokenizer is None:
            self._tokenizer = Tokenizer.from_file(self.path)
        return self._tokenizer

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts on end, and where each text's ids begin."""
        parts, a = [], 0
        while a < len(texts):
            b, size = a + 1, len(texts[a])
            while b < len(texts) and size + len(texts[b]) <= STEP:
                size += len(texts[b])
                b += 1
            parts.append(self._encode(texts[a:b]))
            a = b
        if len(parts) == 1:
            return parts[0]
        shift = np.cumsum([0, *(begins[-1] for _, begins in parts)])
        flat = np.concatenate([ids for ids, _ in parts]) if parts else np.zeros(0, dtype=np.uint32)
        begins = [begins[:-1] + s for (_, begins), s in zip(parts, shift)]
        return flat, np.concatenate([*begins, shift[-1:]]).astype(np.int64)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain = []
        for i, text in enumerate(texts):
            if text and not any(name in text for name in self.special):
                plain.append(i)
        points = np.frombuffer("".join(texts[i] for i in plain).encode("utf-32-le"), dtype=np.uint32)
        sizes = np.array([len(texts[i]) for i in plain], dtype=np.int64)
        ends = np.cumsum(sizes)
        known = self.classes[np.minimum(points, 0x2FFF)]
        odd = np.unique(np.searchsorted(ends, np.flatnonzero((known == UNKNOWN) | (points >= 0x3000)), "right"))
        if len(odd):
            plain = [i for at, i in enumerate(plain) if at not in set(odd.tolist())]
            keep = np.ones(len(sizes), dtype=bool)
            keep[odd] = False
            inside = np.repeat(keep, sizes)
            points, known, sizes = points[inside], known[inside], sizes[keep]
        flat, counts = self._plain("".join(texts[i] for i in plain), points, known, sizes)
        lengths = np.zeros(len(texts), dtype=np.int64)
        lengths[plain] = counts
        rest = sorted(set(range(len(texts))) - set(plain))
        encoded = {}
        for i, found in zip(rest, self.tokenizer.encode_batch([texts[i] for i in rest], add_special_tokens=False) if rest else []):
            encoded[i] = np.array(found.ids, dtype=np.uint32)
            lengths[i] = len(encoded[i])
        begins = np.concatenate([[0], np.cumsum(lengths)])
        if encoded:
            out = np.empty(begins[-1], dtype=np.uint32)
            from_plain = np.repeat(np.isin(np.arange(len(texts)), plain), lengths)
            out[from_plain] = flat
            for i, ids in encoded.items():
                out[begins[i] : begins[i + 1]] = ids
            flat = out
        return flat, begins

    def _plain(self, text: str, points: np.ndarray, kind: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts of known code points, and the number of ids of each."""
        if not len(points):
            return np.zeros(0, dtype=np.uint32), np.zeros(len(sizes), dtype=np.int64)
        starts = word_starts(points, kind, sizes)
        place = np.arange(len(points) + 1)
        if (beyond := points >= 0x80).any():
            wider = beyond.astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
            place[1:] += np.cumsum(wider, dtype=np.int64)
        first = np.flatnonzero(starts)
        offsets = np.append(place[first], place[-1])
        words = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(text.encode()))
        coded = words.dictionary_encode()
        at = self._places(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
        begin = np.cumsum(self.counts) - self.counts
        n = self.counts[at]
        total = np.cumsum(n)
        ids = self.flat[np.repeat(begin[at] - (total - n), n) + np.arange(total[-1])]
        word_end = np.searchsorted(first, np.cumsum(sizes))
        upto = np.concatenate([[0], total])[word_end]
        return ids, np.diff(upto, prepend=0)

    def _places(self, words: pa.LargeStringArray) -> np.ndarray:
        """Places of different words among the known ones, to which new ones are added."""
        at = pc.fill_null(pc.index_in(self.known, value_set=words), -1).to_numpy()  # the table that is made is of fewer words
        places = np.full(len(words), -1, dtype=np.int64)
        places[at[at >= 0]] = np.flatnonzero(at >= 0)
        new = places < 0
        if len(self.known) + new.sum() > KEPT_WORDS:
            places[~new] = self._thin(places[~new])
        self.steps[places[~new]] += 1
        if new.any():
            places[new] = len(self.known) + np.arange(new.sum())
            missing = words.filter(pa.array(new))
            found = list(map(self.ranks.encode_ordinary, missing.to_pylist()))
            self.known = pa.concat_arrays([self.known, missing])
            self.steps = np.append(self.steps, np.ones(len(found), dtype=np.int32))
            self.counts = np.append(self.counts, np.fromiter(map(len, found), np.int64, len(found)))
            self.flat = np.append(self.flat, np.fromiter(itertools.chain.from_iterable(found), np.uint32))
        return places

    def _thin(self, wanted: np.ndarray) -> np.ndarray:
        """Forget all words but those wanted and the half that most steps had; the new places of those wanted.

        Steps count half from then on, so words that come no more go in time.
        """
        keep = np.zeros(len(self.known), dtype=bool)
        keep[np.argsort(-self.steps, kind="stable")[: KEPT_WORDS // 2]] = True
        keep[wanted] = True
        self.known = self.known.filter(pa.array(keep))
        self.flat = self.flat[np.repeat(keep, self.counts)]
        self.steps, self.counts = self.steps[keep] // 2, self.counts[keep]
        return (np.cumsum(keep) - 1)[wanted]


def word_starts(points: np.ndarray, kind: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Where words begin, by the rule of byte-level BPE: a run of letters, numbers or other signs with a
    space before it, if there is one; the contractions 's 't 're 've 'm 'll 'd; white space but for the
    last before a word.
    """
    size = len(points)
    first = np.zeros(size + 1, dtype=bool)
    first[np.cumsum(sizes[:-1])] = True
    first[[0, size]] = True
    begins = first[:-1]
    new = begins.copy()
    new[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    # White space before a word, in the same text, begins a word of its own or the one after it.
    before = np.zeros(size, dtype=bool)
    before[:-1] = space[:-1] & ~space[1:] & ~begins[1:]
    joined = np.zeros(size, dtype=bool)
    joined[1:] = before[:-1] & (points[:-1] == 32)
    starts = (new & ~joined) | before
    sign = np.flatnonzero((points == 39) & starts)
    if len(sign):
        padded = np.append(points, [0, 0, 0])
        ends_at = np.append(first, [True, True, True])
        one, two = padded[sign + 1], padded[sign + 2]
        single = np.isin(one, [ord(c) for c in "stmd"])
        double = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        double &= ~ends_at[sign + 2]
        short = (single | double) & ~ends_at[sign + 1]
        at, length = sign[short], np.where(double[short], 3, 2)
        starts[at + 1] = False
        after = at + length
        starts[after[after < size]] = True
    return starts
