"""Decimal arithmetic, bands, rules and period filters."""

from datetime import date
from decimal import Decimal as D

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from playgauge.functions.classify import difficulty_order, first_match, line_name, power_band
from playgauge.functions.exact import mean_of, pct_gap, per_minute, rate_pct, rounded
from playgauge.functions.period import attempt_duration, in_period, seconds_between


def half_up(numerator: int, denominator: int, digits: int = 2) -> D:
    scaled = abs(numerator) * 10**digits
    whole = (2 * scaled + denominator) // (2 * denominator)
    return D(whole if numerator >= 0 else -whole).scaleb(-digits)


def test_rounds_half_away_from_zero(spark):
    df = spark.sql("SELECT * FROM VALUES (1.005), (0.285), (-1.005), (2.5), (-2.5) AS t(x)")
    rows = df.select(rounded("x").alias("two"), rounded("x", 0).alias("whole")).collect()
    assert [r.two for r in rows] == [D("1.01"), D("0.29"), D("-1.01"), D("2.50"), D("-2.50")]
    assert [int(r.whole) for r in rows] == [1, 0, -1, 3, -3]


@settings(max_examples=3, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 10**12), st.integers(1, 10**12)), min_size=50, max_size=200))
def test_rates_are_exact(spark, pairs):
    df = spark.createDataFrame([(i, min(p), max(p)) for i, p in enumerate(pairs)], "i long, part long, whole long")
    got = {r.i: r.rate for r in df.select("i", rate_pct("part", "whole").alias("rate")).collect()}
    assert got == {i: half_up(min(p) * 100, max(p)) for i, p in enumerate(pairs)}


def test_zero_divisor_gives_null(spark):
    row = spark.range(1).select(
        rate_pct(F.lit(1), F.lit(0)).alias("rate"),
        rounded(pct_gap(F.lit(1), F.lit(D("0.00")))).alias("gap"),
        per_minute(F.lit(10), F.lit(0)).alias("minute"),
        per_minute(F.lit(10), F.lit(None)).alias("unknown"),
    ).first()
    assert list(row) == [None, None, None, None]


def test_mean_skips_null_and_empty_is_null(spark):
    df = spark.sql("SELECT * FROM VALUES ('a', 1), ('a', CAST(NULL AS INT)), ('a', 2), ('b', NULL) AS t(k, x)")
    got = {r.k: r.m for r in df.groupBy("k").agg(rounded(mean_of("x")).alias("m")).collect()}
    assert got == {"a": D("1.50"), "b": None}


def test_pct_gap(spark):
    row = spark.range(1).select(rounded(pct_gap(F.lit(D("8.6333")), F.lit(D("7.00")))).alias("g")).first()
    assert row.g == D("23.33")


def test_band_edges(spark):
    df = spark.createDataFrame(
        [(1, 799, 1000), (2, 800, 1000), (3, 999, 1000), (4, 1000, 1000), (5, 1099, 1000), (6, 1100, 1000),
         (7, 1199, 1000), (8, 1200, 1000), (9, 5, 0), (10, 5, None), (11, None, 1000)],
        "i int, power long, recommended long",
    )
    got = {r.i: r.b[:2] for r in df.select("i", power_band("power", "recommended").alias("b")).collect()}
    assert got == {1: "01", 2: "02", 3: "02", 4: "03", 5: "03", 6: "04", 7: "04", 8: "05", 9: "05", 10: "05", 11: "05"}


def test_first_match_treats_null_as_false(spark):
    df = spark.sql("SELECT * FROM VALUES (1), (5), (NULL) AS t(x)")
    rule = first_match([(F.col("x") > 3, "big"), (F.col("x") > 0, "small")], "none")
    assert [r.c for r in df.select(rule.alias("c")).collect()] == ["small", "big", "none"]


def test_names_and_order(spark):
    df = spark.createDataFrame(
        [("Copper Vault Hard", "hard"), ("Hard Rock", "easy"), ("Easy", "odd"), ("Twin Mythic Easy", "mythic")],
        "n string, d string",
    )
    rows = df.select(line_name("n").alias("line"), difficulty_order("d").alias("o")).collect()
    assert [r.line for r in rows] == ["Copper Vault", "Hard Rock", "Easy", "Twin Mythic"]
    assert [r.o for r in rows] == [3, 1, 99, 4]


def test_period_includes_both_days_and_pushes_down(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.sql(
        "SELECT * FROM VALUES (timestamp_ntz'2026-04-30 23:59:59'), (timestamp_ntz'2026-05-01 00:00:00'),"
        " (timestamp_ntz'2026-05-31 23:59:59'), (timestamp_ntz'2026-06-01 00:00:00') AS t(at)"
    ).write.parquet(path)
    kept = in_period(spark.read.parquet(path), "at", F.lit(date(2026, 5, 1)), F.lit(date(2026, 5, 31)))
    assert kept.count() == 2
    plan = kept._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters:")[1]
    assert "GreaterThanOrEqual(at" in pushed and "LessThan(at" in pushed


def test_durations(spark):
    df = spark.sql(
        "SELECT * FROM VALUES"
        " (1, CAST(NULL AS INT), timestamp_ntz'2026-03-29 01:59:00', timestamp_ntz'2026-03-29 03:00:30'),"
        " (2, 77, timestamp_ntz'2026-01-01 00:00:00', timestamp_ntz'2026-01-01 00:10:00'),"
        " (3, NULL, timestamp_ntz'2026-01-01 00:00:10', timestamp_ntz'2026-01-01 00:00:00'),"
        " (4, NULL, timestamp_ntz'2026-01-01 00:00:00', NULL)"
        " AS t(i, clear_time_sec, attempt_started_at, attempt_ended_at)"
    )
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        rows = df.orderBy("i").select(
            attempt_duration().alias("d"), seconds_between("attempt_started_at", "attempt_ended_at").alias("s")
        ).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert [r.d for r in rows] == [3690, 77, -10, None]
    assert rows[1].s == 600
