"""Columns that operators give back as they were, commits that die, and scratch tables."""

import os

import pytest
from conftest_llm import ODD, prose, rows_of

from playgauge.llm import common, components, mixing, ngram_join, pii, token_rollup, toxicity

CLASHING = "text_key _first row first size readings reading _reading _readings _t _more _base spans base_spans bare node root kind score_ label".split()
ROWS = [(100 + i, f"{prose(i % 7, 12)} mail joe{i}@example.com", ["en", "de", None][i % 3], f"s{i % 3}") for i in range(20)] + ODD


@pytest.fixture(scope="module")
def clashing(spark):
    docs = rows_of(spark, ROWS)
    return docs.selectExpr("*", *(f"concat('{c}', doc_id) AS {c}" for c in CLASHING))


def right(rows):
    return all(r[c] == (None if r["doc_id"] is None else f"{c}{r['doc_id']}") for r in rows for c in CLASHING)


def test_deduplicated(clashing):
    out = ngram_join.deduplicated(clashing)
    rows = out.collect()
    assert out.columns == clashing.columns and rows and right(rows)
    plain = ngram_join.deduplicated(clashing.drop(*CLASHING)).collect()
    assert len(rows) == len(plain)


def test_mixed_documents(clashing):
    out = mixing.mixed_documents(clashing)
    rows = out.collect()
    assert out.columns == clashing.columns and rows and right(rows)
    plain = mixing.mixed_documents(clashing.drop(*CLASHING)).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r["doc_id"]) for r in plain)


def test_sizes_are_counted_whatever_the_columns(clashing):
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    got = mixing.mix(clashing).select(*columns).collect()
    want = mixing.mix(clashing.drop(*CLASHING)).select(*columns).collect()
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_redacted_and_labelled(clashing):
    model = pii.fit(clashing)
    out = pii.redacted(clashing, model)
    rows = out.collect()
    assert out.columns == clashing.columns and right(rows) and len(rows) == len(ROWS)
    assert not any("@example.com" in (r["text"] or "") for r in rows)
    labelled = pii.label_spans(clashing, model)
    assert set(clashing.columns) == set(labelled.columns)
    assert all(r["_t"] == (None if r["doc_id"] is None else f"_t{r['doc_id']}") for r in labelled.collect())


def test_toxicity_keeps_columns(spark, clashing):
    labels = spark.createDataFrame([(100, 1), (101, 0)], "doc_id long, toxic int")
    out = toxicity.toxicity(clashing, labels)
    rows = out.collect()
    assert out.columns == [*clashing.columns, "score", "predicted"] and right(rows) and len(rows) == len(ROWS)


def totals(spark, folder):
    return sorted(tuple(r) for r in token_rollup.totals(spark, folder).collect())


def test_commits_that_die(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "rollup")
    docs = rows_of(spark, [(1, "a b c", "en", "s"), (2, "d", "en", "s")])
    token_rollup.commit(folder, 0, token_rollup.counted(docs, "words-1"))
    want = [("s", "en", "words-1", 2, 4)]
    assert totals(spark, folder) == want

    class Died(Exception):
        pass

    def die(*_):
        raise Died

    log = token_rollup._log
    more = token_rollup.counted(rows_of(spark, [(3, "e f", "en", "s")]), "words-1")
    monkeypatch.setattr(token_rollup, "_log", die)
    for batch in (0, 1):  # a batch again, and a new one: all written, but not logged
        with pytest.raises(Died):
            token_rollup.commit(folder, batch, more)
        assert totals(spark, folder) == want
    # Half of a batch's files, without the mark of a finished job.
    half = tmp_path / "rollup" / "sums" / "batch=2" / "attempt=x"
    more.write.parquet(str(half))
    os.remove(half / "_SUCCESS")
    assert totals(spark, folder) == want
    monkeypatch.setattr(token_rollup, "_log", log)
    token_rollup.commit(folder, 1, more)
    want = [("s", "en", "words-1", 3, 6)]
    assert totals(spark, folder) == want
    token_rollup.commit(folder, 1, more)  # dies after its commit, and runs again
    assert totals(spark, folder) == want
    token_rollup.commit(folder, 0, token_rollup.counted(docs.where("doc_id = 1"), "words-1"))
    assert totals(spark, folder) == [("s", "en", "words-1", 2, 5)]


def test_scratch_tables_go(spark):
    with common.scratch() as made:
        links = spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long")
        kept = common.stored(components.components(links), "kept")
        paths = [df._stored_at for df in made]
        made.remove(kept)
    assert len(paths) >= 2
    assert [os.path.exists(p.removeprefix("file:")) for p in paths].count(True) == 1
    assert {r["root"] for r in kept.collect()} == {0}
