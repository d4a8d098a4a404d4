"""Running totals and ranks in blocks, and requirements counted by ranges, against plain counting."""

import random
from decimal import Decimal

import numpy as np
import pytest
from physical import plan_of
from pyspark.sql import functions as F

from playgauge.functions.ordered import running_totals, with_rank
from playgauge.operators import eligibility


def rows_of(seed, n, values):
    rnd = random.Random(seed)
    return [(rnd.choice("abc") if rnd.random() < 0.9 else None, rnd.choice(values), rnd.randint(0, 5)) for _ in range(n)]


CASES = [
    rows_of(1, 300, range(20)),
    rows_of(2, 300, [*range(1000), None]),
    rows_of(3, 300, [7]),
    rows_of(4, 300, [None]),
    rows_of(5, 200, [1, 1, 1, 1, 1, 2, None]),
    [],
]


@pytest.mark.parametrize("blocks", [2, 3, 16])
@pytest.mark.parametrize("keyed", [True, False])
@pytest.mark.parametrize("case", range(len(CASES)))
def test_totals_and_ranks(spark, case, keyed, blocks):
    rows = CASES[case]
    df = spark.createDataFrame(rows, "k string, v int, a long")
    keys = ["k"] if keyed else []

    def above(row):
        return [o for o in rows if (not keyed or o[0] == row[0]) and (-1 if o[1] is None else o[1]) > (-1 if row[1] is None else row[1])]

    want = {((r[0],) if keyed else ()) + (r[1], sum(o[2] for o in rows if o[1] == r[1] and (not keyed or o[0] == r[0])), sum(o[2] for o in above(r))) for r in rows}
    got = [tuple(r) for r in running_totals(df, "v", ["a"], keys, blocks).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    ranked = with_rank(df, "v", "place", keys, blocks).collect()
    assert sorted(map(str, (tuple(r) for r in ranked))) == sorted(str((*r, len(above(r)) + 1)) for r in rows)


def test_no_window_holds_all_rows(spark):
    df = spark.range(1000).select((F.col("id") % 100).alias("v"), F.lit(1).cast("long").alias("a"))
    plan = plan_of(with_rank(df, "v", "place"))
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert len(windows) == 2 and all("_block" in line for line in windows)
    assert "NestedLoop" not in plan


def counted(content, people, shares):
    out = {}
    for cid, level, power in content:
        counts = []
        for share in shares.values():
            ok = 0
            for has_level, has_power in people:
                meets = level is not None and has_level is not None and has_level >= level
                if share is not None:
                    meets = meets and power is not None and has_power is not None and has_power >= power * share
                ok += meets
            counts.append(ok)
        out[cid] = tuple(counts)
    return out


@pytest.mark.parametrize("seed,levels,powers", [(1, 100, 5000), (2, 3, 10), (3, 1, 1), (4, 1000, 7)])
def test_requirements_by_ranges(spark, seed, levels, powers):
    rnd = random.Random(seed)
    some = lambda top: None if rnd.random() < 0.05 else rnd.randint(-2, top)
    content = [(i, some(levels), some(powers)) for i in range(80)]
    people = [(some(levels + 5), some(powers * 2)) for _ in range(400)]
    shares = {"entry": None, "full": Decimal(1), "near": Decimal("0.85")}
    c = spark.createDataFrame(content, "content_id long, required_level int, recommended_combat_power long")
    p = spark.createDataFrame(people, "level int, combat_power long")
    want = counted(content, people, shares)
    for most in (0, 10_000):
        got = {r.content_id: (r.entry, r.full, r.near) for r in eligibility.threshold_counts(c, p, shares, most_edges=most, blocks=8).collect()}
        assert got == want


def test_a_million_contents(spark):
    contents, people = 1_000_000, 100_000
    level = lambda key, salt: F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(1_000)).cast("int")
    power = lambda key, salt: F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(1_000_000_000))
    c = spark.range(contents).select(F.col("id").alias("content_id"), level("id", 1).alias("required_level"), power("id", 2).alias("recommended_combat_power"))
    # A third of all people share one level and power.
    hot = F.col("id") % 3 == 0
    p = spark.range(people).select(
        F.when(hot, 500).otherwise(level("id", 3)).alias("level"), F.when(hot, F.lit(500_000_000)).otherwise(power("id", 4)).alias("combat_power")
    )
    df = eligibility.threshold_counts(c, p, {"full": Decimal(1)})
    assert "collect_set" not in plan_of(df)
    got = df.where("content_id % 20011 = 0").toPandas().set_index("content_id")["full"]
    assert df.count() == contents
    chosen = c.where("content_id % 20011 = 0").toPandas()
    have = p.toPandas()
    levels, powers = have["level"].to_numpy(), have["combat_power"].to_numpy()
    for row in chosen.itertuples():
        assert got[row.content_id] == np.count_nonzero((levels >= row.required_level) & (powers >= row.recommended_combat_power))
