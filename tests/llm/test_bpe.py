"""Encoding and decoding against the tokenizers library itself."""

import numpy as np
import pytest
from conftest_llm import ODD, rows_of
from hypothesis import given, settings
from hypothesis import strategies as st
from test_contracts import CASES, documents, folders, in_order  # noqa: F401
from tokenizers import Tokenizer

from playgauge.llm import bpe, queries


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.Vocabulary().path)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.Vocabulary().path)


def check(encoder, library, texts):
    for text, ids in zip(texts, encoder.encode(texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, text[:100]
        assert encoder.decode(ids) == library.decode(want, skip_special_tokens=False)


HARD = [
    "",
    " \t\n",
    "hello World's it's 'start ''s \"'s don't I'LL 12345 ½ x²",
    "<|startoftext|>abc<|endoftext|> <|STARTOFTEXT|> <|endoftext|",
    "\0<|endoftext|> \0abc",
    "ΣΑΣ Σ İstanbul ﬁ é é Ⱥ Ⱦ",
    "x\u0085y z\x1c\x1db   ​",
    "漢字 かな 😀😀 한국어 　 a",
    "ß ẞ Ǆ ǅ ᾼ",
    "x" * 5_000,
    "ab" * 300 + "qzj" * 300,
]


def test_hard_texts(encoder, library):
    check(encoder, library, HARD)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_any_text(encoder, library, texts):
    check(encoder, library, texts)


@settings(max_examples=100, deadline=None)
@given(st.text("abcdehilnorst '.19é", max_size=200))
def test_plain_text(encoder, library, text):
    check(encoder, library, [text])


def test_forced_cuts_lie_inside_no_token(encoder):
    signs = bpe.byte_signs()
    rng = np.random.default_rng(5)
    cut = np.argwhere(~encoder.inside)
    every = "\n".join(encoder.tokens.values())
    for a, b in cut[rng.integers(0, len(cut), 200)]:
        assert signs[a] + signs[b] not in every.replace(bpe.WORD_END, "")


def test_a_fragment_is_encoded_alike_alone_and_from_the_heap(encoder, monkeypatch):
    words = ["internationalisation", "zzzzzzqqqq", "aaaaaaa", "abcabcabc" * 20, "mississippi"]
    want = encoder.encode_words(words)
    assert [encoder.encode_words([w])[0] for w in words] == want
    monkeypatch.setattr(bpe, "LONG", 2)
    assert encoder.encode_words(words) == want


@pytest.mark.parametrize("case", CASES)
def test_query(spark, folders, library, case):  # noqa: F811
    import hashlib

    want = []
    for row in documents(folders[case]):
        ids = library.encode(row["text"] or "", add_special_tokens=False).ids
        told = library.decode(ids, skip_special_tokens=False)
        data = np.array(ids, dtype="<u4").tobytes()
        want.append((row["doc_id"], len(ids), hashlib.sha256(data).hexdigest(), hashlib.sha256(told.encode()).hexdigest()))
    assert in_order(tuple(r) for r in queries.op11_bpe(spark, folders[case]).collect()) == in_order(want)


def test_decoding_of_stored_ids_and_clashing_names(spark, library):
    docs = rows_of(spark, ODD).withColumnsRenamed({"lang": "ids", "source": "decoded"})
    coded = bpe.coded(docs)
    assert coded.columns == ["doc_id", "ids"]
    got = in_order(tuple(r) for r in bpe.decoded(coded).collect())
    want = [(i, library.decode(library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False)) for i, t, *_ in ODD]
    assert got == in_order(want)
