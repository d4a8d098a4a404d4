"""Fill-in-middle: unit ends on 64-bit words against a pattern, and outputs that can be undone."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import ODD, rows_of

from playgauge.llm import infill
from playgauge.llm.common import text_bytes

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
SIGNS = " \t\n\r\x0b\x0cab cé漢😀\x1f!\x08\x0e\x7f\x85\xa0"


@pytest.mark.parametrize("seed", range(40))
def test_ends_of_units(seed):
    rnd = random.Random(seed)
    sizes = [rnd.choice([0, 1, 7, 8, 9, 16, rnd.randint(0, 80)]) for _ in range(rnd.randint(0, 12))]
    texts = ["".join(rnd.choice(SIGNS) for _ in range(n)) for n in sizes]
    raw, offsets = text_bytes(pa.array(texts, pa.string()))
    marked = infill.Marked(raw, offsets)
    units = [UNIT.findall(t) for t in texts]
    assert marked.units.tolist() == [len(u) for u in units]
    for _ in range(4):
        k = np.array([rnd.randint(0, len(u)) for u in units], dtype=np.int64)
        want = ["".join(u[:n]) for u, n in zip(units, k)]
        ends = marked.ends(k)
        assert ends.tolist() == [len(w.encode()) for w in want]
        assert marked.chars(ends).tolist() == [len(w) for w in want]


def test_bytes_are_marked_without_carry():
    every = np.arange(256, dtype=np.uint8)
    for shift in range(8):
        words = np.roll(np.tile(every, 8), shift).view("<u8")
        flat = words.view(np.uint8)
        marks = infill.spaces(words).view(np.uint8)
        assert (marks == np.where(np.isin(flat, [32, *range(9, 14)]), 0x80, 0)).all()
        more = infill.continuations(words).view(np.uint8)
        assert (more == np.where((flat & 0xC0) == 0x80, 0x80, 0)).all()


def test_forms_and_outputs(spark):
    rows = [(1000 + i, f"alpha{i} beta\tgamma\n\ndelta  é漢 {'x' * i} ", "en", "s") for i in range(300)]
    rows += [(400, "has <P> in it", "en", "s"), (401, "<S", "en", "s"), (402, ">", "en", "s"), *ODD]
    every = infill.Infill(transformed=100, suffix_first=50)
    docs = rows_of(spark, rows).withColumnsRenamed({"lang": "n", "source": "output"})
    done = infill.infilled(docs, every)
    texts = {i: t for i, t, *_ in rows}
    seen = set()
    for r in done.withColumn("back", infill.restored(how=every)).collect():
        if r["doc_id"] is None:
            continue
        text = texts[r["doc_id"]] or ""
        assert r["back"] == text and r["n"] == len(UNIT.findall(text))
        seen.add(r["form"])
        if r["form"] == "plain":
            assert r["output"] == text and r["prefix_chars"] is None and r["middle_chars"] is None
            assert not text or "<P>" in text
            continue
        a, b = r["prefix_chars"], r["prefix_chars"] + r["middle_chars"]
        x, y, z = text[:a], text[a:b], text[b:]
        assert r["output"] == (f"<P>{x}<S>{z}<M>{y}" if r["form"] == "psm" else f"<S>{z}<P>{x}<M>{y}")
    assert seen == {"plain", "psm", "spm"}


def test_other_sentinels_and_long_texts(spark, monkeypatch):
    how = infill.Infill(seed=1, prefix="[[pre]]", suffix="[[suf]]", middle="[[mid]]", transformed=100, suffix_first=0)
    monkeypatch.setattr(infill, "STEP", 64)
    rows = [(i, "word " * (i * 50), "en", "s") for i in range(40)]
    got = infill.infilled(rows_of(spark, rows), how).withColumn("back", infill.restored(how=how)).collect()
    assert {r["doc_id"]: r["back"] for r in got} == {i: t for i, t, *_ in rows}
    assert {r["form"] for r in got if r["doc_id"]} == {"psm"}
