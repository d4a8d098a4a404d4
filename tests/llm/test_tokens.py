"""Ids of words kept and forgotten, against the tokenizers library."""

from tokenizers import Tokenizer

from playgauge.llm import tokens
from playgauge.llm.packing import Vocabulary

COMMON = "the quick brown fox doesn't jump over 12 lazy dogs at Größe, naïve; Привет мир!"
V = Vocabulary()


def test_words_forgotten_in_between(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT_WORDS", 40)
    monkeypatch.setattr(tokens, "STEP", 300)
    words, library = tokens.Words(V.path, V.ranks_path, V.pattern), Tokenizer.from_file(V.path)
    texts = [f"{COMMON} {' '.join(f'rare{i}x{k}é{i * k}' for k in range(i % 9))}\n\n {'w' * i}" for i in range(120)]
    texts += ["", " ", "漢字 and more", " ".join(map(str, range(700)))]
    for _ in range(2):
        ids, begins = words.encode(texts)
        for text, a, b in zip(texts, begins[:-1], begins[1:], strict=True):
            assert ids[a:b].tolist() == library.encode(text, add_special_tokens=False).ids
    words.encode(["a"] * 3)
    assert len(words.known) == len(words.steps) == len(words.counts) and words.counts.sum() == len(words.flat)


def test_common_words_are_encoded_once(monkeypatch):
    """Words of a single text fill the table again and again; those of all texts stay."""
    monkeypatch.setattr(tokens, "KEPT_WORDS", 100)
    words = tokens.Words(V.path, V.ranks_path, V.pattern)
    encode, done = words.ranks.encode_ordinary, []
    monkeypatch.setattr(words.ranks, "encode_ordinary", lambda word: done.append(word) or encode(word))
    for i in range(40):
        words.encode([f"{COMMON} " + " ".join(f"once{chr(97 + i % 26)}{chr(97 + k)}{'q' * i}" for k in range(20))])
    assert len(words.known) <= 100
    assert len(done) == len(set(done))
