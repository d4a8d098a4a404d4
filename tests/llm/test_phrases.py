"""Phrase collocations against a count of every phrase of every piece."""

import random
import re
from collections import Counter, defaultdict

import pytest
from conftest_llm import ODD, rows_of

from playgauge.llm import phrases
from playgauge.llm.phrases import Mining

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, how):
    counts, words = defaultdict(Counter), Counter()
    for _, text, lang, _ in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\\x0A-\\x0D]", (text or "").translate(LOWER)):
            found = re.findall("[^\\x20\\x09]+", piece)
            words[lang] += len(found)
            for k in range(1, how.words + 1):
                counts[lang].update(" ".join(found[i : i + k]) for i in range(len(found) - k + 1))
    out = []
    for lang, f in counts.items():
        kept = {p: n for p, n in f.items() if n >= how.least and " " in p}
        best = []
        for phrase, a in kept.items():
            w = phrase.split(" ")
            cuts = [(how.factor * a // (f[" ".join(w[:k])] + f[" ".join(w[k:])]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            around = [n for p, n in kept.items() if len(p.split(" ")) > len(w) and f" {phrase} " in f" {p} "]
            if not any(100 * n >= how.inside * a for n in around):
                best.append((-score, -a, phrase.encode(), f[" ".join(w[:k])], f[" ".join(w[k:])]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(best)[: how.top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, words[lang], -score))
    return sorted(out)


def texts(seed, n, vocabulary="a B c d é 漢 f-g".split(), marks=(" ", " ", "  ", "\t", ". ", ",", "\n", "!? ", " ; ")):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        text = "".join(rnd.choice(vocabulary) + rnd.choice(marks) for _ in range(rnd.randint(0, 40)))
        rows.append((i, text, rnd.choice(["en", "de", None]), "s"))
    return rows


@pytest.mark.parametrize("how", [Mining(least=3), Mining(least=2, words=3, top=7), Mining(least=5, inside=50, words=4, top=20), Mining(least=2, words=2)])
@pytest.mark.parametrize("chunk", [1 << 18, 50])
def test_against_all_counts(spark, monkeypatch, how, chunk):
    monkeypatch.setattr(phrases, "CHUNK_WORDS", chunk)
    monkeypatch.setattr(phrases, "STEP", 200)
    monkeypatch.setattr(phrases, "HELD_WORDS", 2 * chunk)
    monkeypatch.setattr(phrases, "LEAST_PARTS", 3)
    rows = texts(chunk, 120) + ODD
    got = phrases.collocations(rows_of(spark, rows).repartition(3), how)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, how)


def test_overlaps_and_scores_past_64_bits(spark):
    rows = [(i, "x " * 50, "en", "s") for i in range(4)]
    how = Mining(least=3, factor=2_000_000_000_00)
    assert sorted(tuple(r) for r in phrases.collocations(rows_of(spark, rows), how).collect()) == brute(rows, how)


def test_empty_and_clashing_names(spark, empty):
    assert phrases.collocations(empty).collect() == []
    rows = texts(1, 30)
    docs = rows_of(spark, rows).withColumnsRenamed({"source": "phrase", "n_chars": "chunk"})
    assert sorted(tuple(r) for r in phrases.collocations(docs, Mining(least=3)).collect()) == brute(rows, Mining(least=3))
