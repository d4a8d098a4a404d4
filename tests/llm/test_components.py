"""Components against plain union-find, and how many steps they take."""

import numpy as np
import pytest

from playgauge.llm import components as module


def plain(links):
    root = {}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in links:
        if u is not None and v is not None and u != v:
            a, b = sorted((find(root.setdefault(u, u)), find(root.setdefault(v, v))))
            root[b] = a
    return {x: find(x) for x in root}


def random_links(seed, nodes, n):
    rng = np.random.default_rng(seed)
    name = rng.permutation(np.array([-(2**62), *range(-9, nodes - 11), 2**62], dtype=np.int64))
    return [tuple(map(int, pair)) for pair in name[rng.integers(0, nodes, (n, 2))]]


@pytest.mark.parametrize("seed", range(20))
def test_forest(seed):
    links = random_links(seed, 60, 5 + 4 * seed)
    nodes, roots = module.forest(*np.array(links).T)
    want = plain(links)
    assert dict(zip(nodes.tolist(), roots.tolist())) == {x: r for x, r in want.items() if x != r}
    assert len(set(nodes.tolist())) == len(nodes)


@pytest.mark.parametrize("chunk", [3, 1_000_000])
def test_components(spark, monkeypatch, chunk):
    monkeypatch.setattr(module, "CHUNK_LINKS", chunk)
    chain = [(1000 + i, 1001 + i) for i in range(50)]
    links = [*random_links(1, 300, 180), *chain, (5, 5), (4000, 4000), (None, 7), (None, None)]
    for rows in (links, [(5, 5)], []):
        out = module.components(spark.createDataFrame(rows, "u long, v long").repartition(5)).collect()
        assert sorted((r["node"], r["root"]) for r in out) == sorted(plain(rows).items())


def test_a_long_chain_takes_few_steps(spark, monkeypatch):
    """A chain that lies in a few tasks is joined up there, and no step is spent on seeing that all is done."""
    written = []
    stored = module.stored
    monkeypatch.setattr(module, "stored", lambda *a: written.append(a[1]) or stored(*a))
    links = spark.range(1, 3000, numPartitions=4).selectExpr("id AS u", "id - 1 AS v")
    out = module.components(links).collect()
    assert len(out) == 3000 and {r["root"] for r in out} == {0}
    assert len(written) <= 3  # 14 without joining up in tasks
