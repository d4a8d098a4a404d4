"""The n-gram join against brute force, in one block and in many."""

import random
import re

import pytest
from conftest_llm import prose, rows_of
from physical import plan_of

from playgauge.llm import ngram_join, trie

UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute(rows):
    """Size and smallest id by position."""
    sets = [shingles(text) for _, text, *_ in rows]
    at = list(range(len(rows)))

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                at[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    least = {k: min((v for v in ids if v is not None), default=None) for k, ids in groups.items()}
    return [(rows[i][0], len(sets[i]), least[find(i)]) for i in range(len(rows))]


def corpus(seed):
    rng = random.Random(seed)
    rows, number = [], 0
    for family in range(12):
        words = prose(family, rng.choice([3, 8, 40, 120, 300])).split()
        if family % 3 == 0:
            words += prose(99, 60).split()  # a passage that families share
        for _ in range(rng.randint(1, 9)):
            copy = list(words)
            for _ in range(rng.randint(0, 1 + len(words) // 60)):
                copy[rng.randrange(len(copy))] = f"edit{rng.randrange(10**6)}"
            text = " ".join(copy)
            rows.append((number, text.upper() if rng.random() < 0.2 else text, "en", "s"))
            number += 1
    rng.shuffle(rows)
    return rows


def result(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id").collect()), key=str)


@pytest.mark.parametrize("block", [1_500_000, 400])
def test_same_components_as_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", block)
    rows = corpus(block)
    assert result(ngram_join.near_duplicates(rows_of(spark, rows))) == sorted(brute(rows), key=str)


def test_odd_rows(spark, odd):
    got = ngram_join.near_duplicates(odd).collect()
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == sorted(
        (x if x[1] else (x[0], 0, x[0]) for x in brute(rows)), key=str
    )
    # One of the three equal texts stays, and every text without words.
    kept = sorted(ngram_join.deduplicated(odd).select("doc_id").collect(), key=str)
    assert [r.doc_id for r in kept] == [1, 2, 3, 4, 5, 7, 8, 9, None, None]


def test_empty_table_and_further_columns(spark, empty, odd):
    assert ngram_join.near_duplicates(empty).count() == 0
    clash = odd.selectExpr("*", "1 AS node", "'x' AS text_key", "2 AS _first")
    assert ngram_join.deduplicated(odd).columns == odd.columns
    assert ngram_join.near_duplicates(clash).count() == odd.count()


@pytest.mark.parametrize("burst", [2, 24])
def test_trie_joins_like_brute_force(monkeypatch, burst):
    import numpy as np

    monkeypatch.setattr(trie, "BURST", burst)
    rng = random.Random(burst)
    for _ in range(150):
        sets = {}
        for _ in range(rng.randint(1, 8)):
            base = set(rng.sample(range(60), rng.randint(1, 20)))
            for _ in range(rng.randint(1, 6)):
                one = set(base)
                for _ in range(rng.randint(0, 4)):
                    one.symmetric_difference_update({rng.randrange(60)})
                if one:
                    sets[frozenset(one)] = np.array(sorted(one), dtype=np.int32)
        lists, keys = list(sets.values()), list(sets)
        at = list(range(len(keys)))

        def find(x, at=at):
            while at[x] != x:
                x = at[x]
            return x

        for i in range(len(keys)):
            for j in range(i):
                if 100 * len(keys[i] & keys[j]) >= 80 * len(keys[i] | keys[j]):
                    a, b = sorted((find(i), find(j)))
                    at[b] = a
        assert trie.join_sets(lists, None, 80) == [find(i) for i in range(len(keys))]


def chained(families):
    """Texts of 100 words, of which each shares 20 with the next, and in every third family an edited copy."""
    rows = []
    for f in range(families):
        words = prose(f, 20).split() + prose(1000 + f, 60).split() + prose(f + 1, 20).split()
        rows.append((2 * f, " ".join(words), "en", "s"))
        if f % 3 == 0:
            rows.append((2 * f + 1, " ".join([*words[:50], "edited", *words[51:]]), "en", "s"))
    return rows


def test_texts_with_enough_of_their_own_go_no_further(spark, monkeypatch):
    seen = []

    def spied(tokens, percent, groups=ngram_join._groups):
        seen.extend(r.node for r in tokens.select("node").distinct().collect())
        return groups(tokens, percent)

    monkeypatch.setattr(ngram_join, "_groups", spied)
    rows = chained(30)
    assert result(ngram_join.near_duplicates(rows_of(spark, rows))) == sorted(brute(rows), key=str)
    # Two of each third family; a passage shared with the next family ties none of the others.
    assert len(seen) == 20


@pytest.mark.parametrize("piece, parts", [(1, 64), (150, 7), (10**6, 1)])
def test_pieces_and_parts_of_any_size(spark, monkeypatch, piece, parts):
    monkeypatch.setattr(ngram_join, "PIECE_NUMBERS", piece)
    monkeypatch.setattr(ngram_join, "LEAST_PARTS", parts)
    rows = corpus(piece) + chained(5)
    rows = [(i, *row[1:]) for i, row in enumerate(rows)]
    assert result(ngram_join.near_duplicates(rows_of(spark, rows))) == sorted(brute(rows), key=str)


def test_just_similar_and_just_not(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "FIRST_SHARE", 1)
    words = [prose(i, 14).split() for i in range(4)]
    # 8 of 10 shingles, and 7 of 10.
    rows = [(1, " ".join(words[0]), "en", "s"), (2, " ".join(words[0][:12]), "en", "s")]
    rows += [(3, " ".join(words[1]), "en", "s"), (4, " ".join(words[1][:11]), "en", "s")]
    assert result(ngram_join.near_duplicates(rows_of(spark, rows))) == [(1, 10, 1), (2, 8, 1), (3, 10, 3), (4, 7, 4)]


def test_numbers_written_as_differences():
    import numpy as np

    for values in ([], [5], [5, 5, 6], [0, 255, 256, 2**39, 2**40 - 1]):
        values = np.array(values, dtype=np.uint64)
        for start in (0, int(values[0]) if len(values) else 3):
            data = ngram_join._written(values, start)
            assert ngram_join._read(data, len(values), start).tolist() == values.tolist()


def test_documents_kept_are_dealt_out_once(spark, odd):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(ngram_join.deduplicated(odd))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # Repeated rows are numbered where the join has put them.
    between = plan[plan.index("Window ") : plan.index("SortMergeJoin")]
    assert "Sort " in between and "Exchange" not in between
