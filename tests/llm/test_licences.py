"""Licences of several paragraphs between other paragraphs, against the forms of all runs of paragraphs."""

import re

import pytest
from conftest_llm import prose, rows_of

from playgauge.llm import licences

FULL = [(name, text) for name, texts in licences.KNOWN.items() for text in texts if "\n\n" in text]


def found(df):
    return sorted((r["doc_id"], r["unit"], r["number"], r["licence"]) for r in df.collect())


def test_full_texts_between_pieces_of_prose(spark):
    assert {name for name, _ in FULL} == {"MIT", "ISC", "0BSD"}
    rows = [(i, f"{prose(i, 9)}\n\n{prose(i, 4)}\n\n{text}\n\n{prose(i + 1, 9)}", "en", "s") for i, (_, text) in enumerate(FULL)]
    assert found(licences.scan(rows_of(spark, rows))) == [(i, "paragraphs", 3, name) for i, (name, _) in enumerate(FULL)]


def test_runs_skip_empty_paragraphs_and_notices(spark):
    mit = licences.KNOWN["MIT"][0]
    first, rest = mit.split("\n\n", 1)
    texts = [
        mit,  # all of the document: the text itself
        f"{mit}\n\nint main() {{}}",
        f"int main() {{}}\n\n{mit}",
        f"code\n\nMIT License\n\nCopyright (c) 2020 someone\n\n{mit}\n\ncode",
        f"code\n\n\n\n\n{first}\n \n\t\n\n\n{rest}\n\n---\n\ncode",
        f"code\n\n{first}\n\nother words\n\n{rest}\n\ncode",  # not whole
        f"{mit}\n\n{mit}",
    ]
    got = found(licences.scan(rows_of(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])))
    at = {4: next(i for i, p in enumerate(re.split(licences.PARAGRAPHS, texts[4]), 1) if first in p)}
    assert got == [
        (0, "text", 1, "MIT"),
        (1, "paragraphs", 1, "MIT"),
        (2, "paragraphs", 2, "MIT"),
        (3, "paragraphs", 4, "MIT"),
        (4, "paragraphs", at[4], "MIT"),
        (6, "paragraphs", 1, "MIT"),
        (6, "paragraphs", 4, "MIT"),
    ]


@pytest.mark.parametrize("n", [2, 4])
def test_lengths_come_from_the_given_texts(spark, n):
    text = "\n\n".join(f"clause {i} holds\nhere" for i in range(n))
    notice = f"Copyright (c) 2020 someone\n\n{text}\n\n---"
    assert licences.run_lengths({"own": [text, notice], "line": ["one line"]}) == [n]
    docs = rows_of(spark, [(1, f"before\n\n{text}\n\nafter", "en", "s"), (2, "a\n\nb\n\nc\n\nd\n\ne", "en", "s")])
    assert found(licences.scan(docs, {"own": [notice]})) == [(1, "paragraphs", 2, "own")]
