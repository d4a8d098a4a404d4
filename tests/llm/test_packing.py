"""Best fit under capacities of tokens, pieces and cost that each bind, against a direct check."""

import numpy as np
import pytest

from playgauge.llm.packing import PIECES, Capacity, best_fit, pack

BINDING = [
    Capacity(tokens=100, pieces=3, cost=100 * 100),
    Capacity(tokens=100, pieces=100, cost=2_500),
    Capacity(tokens=100, pieces=4, cost=3_000),
]


@pytest.mark.parametrize("capacity", BINDING)
@pytest.mark.parametrize("seed", range(5))
def test_sequences_keep_every_capacity(capacity, seed):
    length = np.random.default_rng(seed).integers(1, 50, 400)
    bins, offsets = best_fit(length, capacity)
    tokens_only, _ = best_fit(length, Capacity(tokens=100))
    held = {b: np.flatnonzero(bins == b) for b in set(bins.tolist())}
    for at in held.values():
        at = at[np.argsort(offsets[at])]
        assert offsets[at].tolist() == [0, *np.cumsum(length[at])[:-1].tolist()]
        assert length[at].sum() <= capacity.tokens and len(at) <= capacity.pieces
        assert (length[at] ** 2).sum() <= capacity.cost
    assert set(held) == set(range(len(held))) and sum(map(len, held.values())) == len(length)
    # Packing by tokens alone breaks the other capacities, so they do bind here.
    worst = [np.flatnonzero(tokens_only == b) for b in set(tokens_only.tolist())]
    assert any(len(at) > capacity.pieces or (length[at] ** 2).sum() > capacity.cost for at in worst)


def test_a_piece_that_fits_no_sequence_is_refused():
    with pytest.raises(ValueError):
        best_fit(np.array([60]), Capacity(tokens=100, cost=2_500))


@pytest.mark.parametrize("capacity", BINDING)
def test_packed_groups_keep_every_capacity(spark, capacity):
    length = np.random.default_rng(9).integers(1, 50, 300).tolist()
    cut = spark.createDataFrame([(i, 0, 0, n, i, i) for i, n in enumerate(length)], PIECES)
    rows = pack(cut, capacity, group_rows=100).collect()
    assert sorted((r["doc_id"], r["length"]) for r in rows) == list(enumerate(length))
    held = {}
    for r in rows:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in held.values():
        sizes = [n for _, n in sorted(parts)]
        assert [at for at, _ in sorted(parts)] == [sum(sizes[:k]) for k in range(len(sizes))]
        assert sum(sizes) <= capacity.tokens and len(sizes) <= capacity.pieces and sum(n * n for n in sizes) <= capacity.cost
