"""Licence scan: canonical digests of entire texts, joined to the digests of known licences.

A text unit is put into canonical form: lower case; lines that state a copyright go; spellings that mean the
same become one; everything but letters and digits becomes single spaces. Units are the entire document, its
paragraphs (parted by blank lines), its lines, and runs of as many paragraphs as a known text has, so that a
licence pasted between other paragraphs is found whole. Paragraphs that are empty in canonical form, such as a
copyright notice, neither count in a run nor part it. A licence that shares its first or last paragraph with other
text is not found.
A unit holds a licence if the SHA-256 of its canonical form is that of one of the licence's texts.

Nulls and unusual input: a null text has no units; units that are empty in canonical form match nothing. Rows of
null or repeated ``doc_id`` are scanned like others. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Known texts go to every task, so their number is bounded.
MOST_TEXTS = 50_000

# Public licence texts and notices, by SPDX identifier where there is one.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_HEAD = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted"""
_ISC_TAIL = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING
ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""
KNOWN: dict[str, tuple[str, ...]] = {
    "MIT": (_MIT, "The MIT License\n" + _MIT, "MIT License\n" + _MIT, "Released under the MIT License.", "Licensed under the MIT License."),
    "ISC": (
        f"{_ISC_HEAD}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_TAIL}",
    ),
    "0BSD": (f"{_ISC_HEAD}.\n\n{_ISC_TAIL}",),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "all-rights-reserved": ("All rights reserved.",),
}
#: Spellings that mean the same, as patterns on lower-case text, with what they become; in this order.
SAME: tuple[tuple[str, str], ...] = (
    (r"licence", "license"),
    (r"sub-license", "sublicense"),
    (r"non-infringement", "noninfringement"),
    (r"merchantibility", "merchantability"),
    (r"version ", "v"),
    (r"and/or", "and or"),
    (r"copyright owner", "copyright holder"),
    (r"https:", "http:"),
)
#: What parts paragraphs.
PARAGRAPHS = r"\n[\x20\t\r]*\n"
#: A line that states a copyright: the word or sign, then a year or a name's sign.
COPYRIGHT_LINE = r"(?m)^[^a-z0-9\n]*(?:copyright (?:\(c\)|©|[0-9])|\(c\) (?:copyright|[0-9])|© ?(?:copyright|[0-9]))[^\n]*$"


def canonical(text: Column | str) -> Column:
    """Canonical form of a text unit."""
    out = F.lower(F.col(text) if isinstance(text, str) else text)
    out = F.regexp_replace(out, COPYRIGHT_LINE, " ")
    for pattern, one in SAME:
        out = F.regexp_replace(out, pattern, one)
    return F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))


def known_digests(spark: SparkSession, texts: Mapping[str, Sequence[str]] = KNOWN) -> DataFrame:
    """``licence`` and ``digest`` of every known text."""
    rows = [(licence, text) for licence, all_ in texts.items() for text in all_]
    if len(rows) > MOST_TEXTS:
        raise ValueError(f"at most {MOST_TEXTS} licence texts")
    made = spark.createDataFrame(rows, "licence string, text string")
    return made.select("licence", F.sha2(canonical("text"), 256).alias("digest")).distinct()


def run_lengths(texts: Mapping[str, Sequence[str]] = KNOWN) -> list[int]:
    """Numbers of paragraphs, from 2 on, that known texts have; those empty in canonical form don't count."""

    def holds(part: str) -> bool:
        return any(sign.isalnum() for sign in re.sub(COPYRIGHT_LINE, " ", part.lower()))

    counts = {sum(map(holds, re.split(PARAGRAPHS, text))) for all_ in texts.values() for text in all_}
    return sorted(n for n in counts if n > 1)


def units(docs: DataFrame, lengths: Sequence[int] = ()) -> DataFrame:
    """``doc_id``, ``unit`` (text, paragraph, line or paragraphs), its ``number`` (from 1) and canonical ``form``.

    ``paragraphs`` are runs of ``lengths`` paragraphs, numbered by their first one; a run of all is the text.
    """
    text = F.col("text").cast("string")
    lines, paragraphs = F.split(text, "\n"), F.split(text, PARAGRAPHS)

    def unit(kind: str, number: Column, part: Column, form: Column) -> Column:
        return F.struct(F.lit(kind).alias("unit"), number.cast("long").alias("number"), part.alias("part"), form.alias("form"))

    none = F.lit(None).cast("string")

    def numbered(kind: str, parts: Column) -> Column:
        return F.transform(parts, lambda x, i: unit(kind, i + 1, x, none))

    def runs(forms: Column, n: int) -> Column:
        def run(i: Column) -> Column:
            held = F.slice(forms, i, n)
            return unit("paragraphs", held[0]["number"], none, F.array_join(F.transform(held, lambda p: p["form"]), " "))

        return F.transform(F.when(F.size(forms) > n, F.sequence(F.lit(1), F.size(forms) - n + 1)).otherwise(F.array().cast("array<int>")), run)

    # A text of one line, or a paragraph of one line, is one unit only.
    several = F.filter(numbered("paragraph", paragraphs), lambda x: x["part"].contains("\n"))
    every = [
        numbered("text", F.array(text)),
        F.when(F.size(paragraphs) > 1, several).otherwise(F.slice(several, 1, 0)),
        F.when(F.size(lines) > 1, numbered("line", lines)).otherwise(F.slice(numbered("line", lines), 1, 0)),
    ]
    if lengths:
        forms = F.filter(
            F.transform(paragraphs, lambda x, i: F.struct((i + 1).alias("number"), canonical(x).alias("form"))),
            lambda p: p["form"] != "",
        )
        # Bound as a variable, so that the forms are computed once for all lengths.
        found = F.flatten(F.transform(F.array(forms), lambda held: F.concat(*(runs(held, n) for n in lengths))))
        every.append(F.when(F.size(paragraphs) > min(lengths), found).otherwise(F.slice(numbered("text", F.array(text)), 1, 0)))
    return (
        docs.where(text.isNotNull())
        .select("doc_id", F.explode(F.concat(*every)).alias("u"))
        .select("doc_id", "u.unit", "u.number", F.coalesce("u.form", canonical(F.col("u.part"))).alias("form"))
    )


def scan(docs: DataFrame, texts: Mapping[str, Sequence[str]] = KNOWN) -> DataFrame:
    """One row per unit that is a known licence: doc_id, unit, number, licence."""
    known = known_digests(docs.sparkSession, texts)
    found = units(docs, run_lengths(texts)).select("doc_id", "unit", "number", F.sha2("form", 256).alias("digest"))
    empty = F.sha2(F.lit(""), 256)
    return (
        found.where(F.col("digest") != empty)
        .join(F.broadcast(known), "digest")  # at most MOST_TEXTS rows
        .select("doc_id", "unit", "number", "licence")
    )
