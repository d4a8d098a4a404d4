"""SimHash: votes counted by hand, and neighbours within the radius against all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest

from playgauge.llm import simhash
from playgauge.llm.common import gram_hashes, mixed, word_hashes


def by_hand(text, n=3):
    words, begins = word_hashes(pa.array([text]))
    grams, _ = gram_hashes(words, begins, n, whole_if_short=True)
    votes = [0] * simhash.BITS
    for gram in grams.tolist():
        other = int(mixed(np.array([gram ^ 0xA5A5A5A5A5A5A5A5], dtype=np.uint64))[0])
        data = gram.to_bytes(8, "little") + other.to_bytes(8, "little")
        for byte, value in enumerate(data):
            for bit in range(8):
                votes[byte * 8 + bit] += 1 if value >> bit & 1 else -1
    return votes


@pytest.mark.parametrize("text", ["", "one", "a b", "a b c d e f g a b c d", "x " * 50 + "y z " * 7, " ".join(map(str, range(300)))])
def test_bits_are_the_sign_of_the_votes(text):
    found = np.unpackbits(simhash.fingerprints(pa.array([text])), axis=1)[0]
    # The order of bits within a byte is free, but the same for all.
    votes = np.array(by_hand(text)).reshape(16, 8)
    assert (found.reshape(16, 8) == (votes > 0)).all() or (found.reshape(16, 8) == (votes > 0)[:, ::-1]).all()


def near(rnd, base, bits):
    return base ^ sum(1 << b for b in rnd.sample(range(128), bits))


@pytest.mark.parametrize("slices,dealt", [(20_000, 50_000), (7, 50)])
@pytest.mark.parametrize("radius", [0, 1, 3])
def test_near_counts(spark, monkeypatch, slices, dealt, radius):
    monkeypatch.setattr(simhash, "SLICE", slices)
    monkeypatch.setattr(simhash, "DEALT_ROWS", dealt)
    monkeypatch.setattr(simhash, "STEP_PAIRS", 64)
    rnd = random.Random(radius)
    bases = [rnd.getrandbits(128) for _ in range(6)]
    every = [near(rnd, rnd.choice(bases), rnd.randint(0, 4)) for _ in range(150)] + [near(rnd, bases[0], 1) for _ in range(60)] + [0, (1 << 128) - 1]
    asked = every[::5] + [rnd.getrandbits(128), near(rnd, bases[1], 2)]
    frame = lambda xs: spark.createDataFrame([(f"{x:032x}",) for x in [*xs, *xs[:9]]] + [(None,)], "fingerprint string")
    got = {r["fingerprint"]: r["n_near"] for r in simhash.near_counts(frame(asked), frame(every), radius).collect()}
    assert got == {f"{a:032x}": sum(0 < (a ^ b).bit_count() <= radius for b in set(every)) for a in asked}


def test_near_counts_of_nothing(spark):
    none = spark.createDataFrame([], "fingerprint string")
    assert simhash.near_counts(none, none).collect() == []
