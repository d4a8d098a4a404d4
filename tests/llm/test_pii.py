"""Wider candidates of personal data: the quick test in front of a pattern drops none of its matches."""

import itertools

import pytest
from conftest_llm import prose, rows_of

from playgauge.llm import pii

SIGNS = ["(at)", " (at) ", "[at]", " [AT] ", " at ", " At "]
POINTS = [".", "(dot)", " (dot) ", "[dot]", " [dot] ", " dot ", " DOT "]
SPELLED = ["joe at example.com", "joe at example (dot) com", "joe at example [dot] com"]


def test_every_spelling_is_a_candidate(spark):
    spelled = [f"joe{sign}example{point}com" for sign, point in itertools.product(SIGNS, POINTS)]
    docs = rows_of(spark, [(i, f"so {text}, yes", "en", "s") for i, text in enumerate([*SPELLED, *spelled])])
    got = {r["doc_id"]: r["_more"] for r in pii.candidates(docs).collect()}
    for i, text in enumerate([*SPELLED, *spelled]):
        assert [(c["kind"], c["form"], c["s"], c["e"]) for c in got[i]] == [(0, 1, 3, 3 + len(text))], text


def test_other_wider_patterns_pass_their_quick_test(spark):
    texts = ["1:2:3:4:5:6:7:abcd", "(212) 555-0100", "212.555.0100", "212 555 0100"]
    docs = rows_of(spark, [(i, text, "en", "s") for i, text in enumerate(texts)])
    got = {r["doc_id"]: r["_more"] for r in pii.candidates(docs).collect()}
    assert [[(c["s"], c["e"]) for c in got[i] if c["form"] == 1] for i in range(4)] == [[(0, len(t))] for t in texts]


@pytest.mark.parametrize("text", SPELLED)
def test_spelled_addresses_are_redacted(spark, text):
    plain = [(i, f"{prose(i, 5)} mail joe{i}@example.com", "en", "s") for i in range(20)]
    docs = rows_of(spark, [*plain, (20, f"Write to {text}.", "en", "s"), (21, "We met at noon. Then dot by dot at home.", "en", "s")])
    got = {r["doc_id"]: r["text"] for r in pii.redacted(docs, pii.fit(docs)).collect()}
    assert "joe at" not in got[20] and "<EMAIL>" in got[20]
    assert got[21] == "We met at noon. Then dot by dot at home."
