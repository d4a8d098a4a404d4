"""FTRL-proximal steps against the update written out, coordinate by coordinate."""

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from playgauge.llm import toxicity
from playgauge.llm.toxicity import Ftrl


def by_hand(texts, labels, offset, p):
    sets = []
    for text in texts:
        at, _ = toxicity.features(pa.array([text], pa.string()), p.bits)
        sets.append(set(at.tolist()))
    seen = defaultdict(int)
    for own in sets:
        for i in own:
            seen[i] += 1
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        if abs(z[i]) <= p.l1:
            return 0.0
        return -(z[i] - math.copysign(p.l1, z[i])) / ((p.beta + math.sqrt(n[i])) / p.alpha + p.l2)

    for _ in range(max(1, math.ceil(p.steps / len(texts)))):
        for own, label in zip(sets, labels):
            used = [i for i in own if seen[i] >= p.least_rows]
            before = {i: weight(i) for i in used}
            chance = 1 / (1 + math.exp(-(offset + sum(before.values()))))
            g = chance - label
            for i in used:
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / p.alpha
                z[i] += g - sigma * before[i]
                n[i] += g * g
    return {i: weight(i) for i in z if weight(i)}


TEXTS = ["you are bad bad", "you are good", "bad thing here", "good thing there", "", "you bad thing", "a good day", "bad bad bad day"] * 4
LABELS = np.array([1, 0, 1, 0, 0, 1, 0, 1] * 4)


@pytest.mark.parametrize("p", [
    Ftrl(bits=16, l1=0.0, least_rows=1, steps=1),
    Ftrl(bits=16, l1=0.3, least_rows=3, steps=200),
    Ftrl(bits=12, l1=1.0, l2=0.5, alpha=0.2, least_rows=2, steps=64),
    Ftrl(bits=16, l1=100.0, steps=64),
])
def test_steps(p):
    at, w = toxicity._ftrl(TEXTS, LABELS, -1.0, p)
    want = by_hand(TEXTS, LABELS, -1.0, p)
    got = {i: x for i, x in zip(at.tolist(), w.tolist()) if x}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[i], want[i], rel_tol=1e-9, abs_tol=1e-12) for i in want)
    assert (p.l1 < 100) == bool(got)
