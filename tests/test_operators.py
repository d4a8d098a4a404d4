"""Operators on small hand-made tables; expected values are worked out by hand."""

from datetime import date
from decimal import Decimal as D

import game
import pytest
from pyspark.sql import functions as F

from playgauge.operators import (
    difficulty,
    eligibility,
    gap,
    health,
    participation,
    patterns,
    profile,
    quality,
    release,
    rewards,
    segments,
    targets,
    usage,
)
from playgauge.sources.reader import with_collation

MAY = (date(2026, 5, 1), date(2026, 5, 31))


class Game:
    def __init__(self, spark):
        self.content = game.contents(spark)
        self.characters = game.characters(spark)
        self.goals = game.goals(spark)
        self.attempts = game.attempts(spark)
        self.activity = game.activity(spark)
        self.rewards = game.rewards(spark)
        self.patterns = game.patterns(spark)


@pytest.fixture(scope="module")
def g(spark):
    return Game(spark)


def by(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}


# ------------------------------------------------------------------ quality


def test_rules(spark, g):
    payments = game.make(
        spark,
        "payments",
        [
            {"paid_at": game.day("2026-05-02"), "refund_at": game.day("2026-05-01")},
            {"paid_at": game.day("2026-05-02"), "refund_at": game.day("2026-05-03")},
            {"paid_at": game.day("2026-05-02"), "refund_at": None},
        ],
    )
    tables = {"daily_activity": g.activity, "content_attempts": g.attempts, "payments": payments}
    got = {r.rule: r.violations for r in quality.run_rules(tables, quality.standard_rules()).collect()}
    assert got == {
        "invalid_playtime_over_24h": 1,
        "invalid_attempt_time_reverse": 1,
        "invalid_clear_without_clear_time": 1,
        "invalid_refund_time_reverse": 1,
    }


def test_reward_on_failed(g):
    row = quality.reward_on_failed(g.rewards, g.attempts).first()
    assert row.violations == 2  # attempts 2 (fail) and 4 (give up); attempt 6 got a drop


def test_reward_on_failed_without_any(g):
    assert quality.reward_on_failed(g.rewards, g.attempts.filter("result = 'clear'")).first().violations == 0


def orphan_tables(spark):
    return {
        "accounts": game.make(spark, "accounts", [{"account_id": 1}]),
        "characters": game.make(spark, "characters", [{"character_id": 1, "account_id": 1}, {"character_id": 2, "account_id": 8}]),
        "content_master": game.make(spark, "content_master", [{"content_id": 1}]),
        "content_attempts": game.make(
            spark,
            "content_attempts",
            [
                {"attempt_id": 1, "account_id": 1, "character_id": 1, "content_id": 1},
                {"attempt_id": 2, "account_id": 1, "character_id": 7, "content_id": 1},
                {"attempt_id": 3, "account_id": 1, "character_id": 7, "content_id": 9},
                {"attempt_id": 4, "account_id": 6, "character_id": 1, "content_id": 1},
            ],
        ),
        "boss_pattern_logs": game.make(spark, "boss_pattern_logs", [{"attempt_id": 1}, {"attempt_id": 50}, {"attempt_id": 50}]),
        "reward_logs": game.make(spark, "reward_logs", [{"attempt_id": 1}, {"attempt_id": None}, {"attempt_id": 60}]),
    }


def test_orphans(spark):
    t = orphan_tables(spark)
    got = {r.fk: r.orphan_rows for r in quality.orphan_summary(t).collect()}
    assert list(got.values()) == [1, 2, 1, 2, 1]
    listed = quality.orphans(t["boss_pattern_logs"], "attempt_id", t["content_attempts"], "attempt_id")
    assert [r.attempt_id for r in listed.collect()] == [50, 50]
    rewarded = (t["reward_logs"], "attempt_id", t["content_attempts"], "attempt_id")
    assert [r.attempt_id for r in quality.orphans(*rewarded, ignore_null=True).collect()] == [60]
    assert {r.attempt_id for r in quality.orphans(*rewarded).collect()} == {60, None}


def test_orphans_multi_counts_a_row_once(spark):
    t = orphan_tables(spark)
    parents = [
        quality.Parent("account_id", t["accounts"], "account_id"),
        quality.Parent("character_id", t["characters"], "character_id"),
        quality.Parent("content_id", t["content_master"], "content_id"),
    ]
    assert quality.orphans_multi(t["content_attempts"], parents).first().orphan_rows == 3
    assert quality.orphans_multi(t["content_attempts"].limit(0), parents).first().orphan_rows == 0


def test_duplicates_and_profile(spark):
    from playgauge.sources.schemas import TABLES

    df = game.make(spark, "payments", [{"payment_id": 1}, {"payment_id": 1}, {"payment_id": 2, "payment_method": "y" * 31}])
    assert [tuple(r) for r in quality.pk_duplicates(df, ["payment_id"]).collect()] == [(1, 2)]
    lines = by(quality.null_profile(df, TABLES["payments"]), "column_name")
    assert lines["payment_method"].nulls == 2 and lines["payment_method"].null_violations == 0
    assert lines["payment_method"].over_length == 1
    broken = df.withColumnRenamed("product_type", "old").selectExpr("*", "CAST(NULL AS STRING) AS product_type")
    assert by(quality.null_profile(broken, TABLES["payments"]), "column_name")["product_type"].null_violations == 3
    assert by(quality.null_profile(df.drop("product_type"), TABLES["payments"]), "column_name")["product_type"].null_violations == 3


def test_shares_of_power_are_not_rounded(spark):
    from decimal import Decimal

    from playgauge.operators import eligibility

    content = spark.createDataFrame([(1, 1, 3)], "content_id long, required_level int, recommended_combat_power long")
    for kind in ("long", "decimal(12,2)", "double"):
        people = spark.createDataFrame([(1, 1), (1, 2), (1, 10**15)], "level int, combat_power long")
        people = people.withColumn("combat_power", people.combat_power.cast(kind if kind != "decimal(12,2)" else "decimal(20,2)"))
        got = eligibility.threshold_counts(content, people, {"some": Decimal("0.33334"), "all": Decimal("1"), "level": None})
        assert tuple(got.first()) == (1, 2, 1, 3)


# ------------------------------------------------------------------ profiles


def test_population(spark, g):
    accounts = game.make(
        spark,
        "accounts",
        [{"account_id": i, "account_status": s, "is_tester": t} for i, s, t in
         [(1, "active", 0), (2, "active", 1), (3, "banned", 0), (4, "dormant", 0), (5, "active", 0), (6, "active", 0)]],
    )
    row = profile.population_summary(accounts, g.characters).first()
    assert (row.total_account_count, row.active_account_count, row.non_active_account_count) == (6, 4, 2)
    assert (row.tester_account_count, row.normal_account_count) == (1, 5)
    assert (row.total_character_count, row.active_character_count, row.deleted_character_count) == (10, 9, 1)
    assert row.avg_character_count_per_account == D("1.67")
    assert row.avg_active_character_level == D("9.89")  # 89 / 9
    assert row.avg_active_character_combat_power == D("1466.22")  # 13196 / 9


def test_daily_kpis(g):
    rows = by(profile.daily_kpis(g.activity), "activity_date")
    first = rows[date(2026, 5, 10)]
    assert (first.dau, first.active_character_count, first.total_login_count) == (1, 2, 3)
    assert first.avg_play_minutes_per_account == D("90.00")
    assert rows[date(2026, 5, 13)].dau == 2 and rows[date(2026, 5, 13)].active_character_count == 3


def test_spans_and_counts(g):
    span = profile.date_spans([("a", g.activity, "activity_date"), ("b", g.attempts, "attempt_started_at")])
    rows = by(span, "date_source")
    assert (rows["a"].date_span_days, rows["a"].row_count) == (15, 9)
    assert (rows["b"].min_date, rows["b"].max_date, rows["b"].date_span_days) == (date(2026, 5, 10), date(2026, 6, 20), 42)
    counts = profile.row_counts({"x": g.activity, "y": g.patterns}, sort=True).collect()
    assert [(r.table_name, r.row_count) for r in counts] == [("y", 11), ("x", 9)]


def test_distributions(g):
    rows = by(profile.daily_result_distribution(g.attempts), "attempt_date", "attempt_result")
    clear = rows[(date(2026, 5, 10), "clear")]
    assert (clear.attempt_count, clear.participant_account_count, clear.participant_character_count) == (4, 3, 4)
    assert clear.avg_clear_time_sec == D("46.67")  # 90, 0, 50; the missing one is skipped
    total = profile.overall_summary(g.attempts).first()
    assert (total.date_count, total.total_attempt_count, total.clear_rate_pct) == (2, 9, D("44.44"))
    assert total.participant_account_count == 5 and total.participant_character_count == 8
    shares = [(r.attempt_result, r.attempt_rate_pct) for r in profile.result_share(g.attempts).collect()]
    assert shares == [("clear", D("44.44")), ("fail", D("33.33")), ("disconnect", D("11.11")), ("give_up", D("11.11"))]


# ------------------------------------------------------------------ health


def test_health(g):
    h = health.content_health(g.attempts, g.content)
    rows = by(h, "content_id")
    assert set(rows) == {1, 3, 4, 5}  # content 2 has no attempts
    one = rows[1]
    assert (one.total_attempt_count, one.participant_account_count, one.participant_character_count) == (6, 4, 5)
    assert [one.clear_rate_pct, one.fail_rate_pct, one.give_up_rate_pct, one.disconnect_rate_pct] == [
        D("33.33"), D("33.33"), D("16.67"), D("16.67")]
    assert one.avg_clear_time_sec == D("90.00") and one.avg_death_count == D("3.33")
    assert one.reward_claimed_rate_pct == D("33.33")
    assert rows[5].avg_clear_time_sec is None
    total = health.health_rollup(h).first()
    assert (total.content_count, total.total_attempt_count, total.max_attempt_count) == (4, 9, 6)
    assert total.avg_clear_rate_pct == D("58.33")  # (33.33 + 100 + 100 + 0) / 4 = 58.3325
    assert total.avg_clear_time_sec == D("46.67")
    worst = [r.content_id for r in health.worst_contents(h, 2).collect()]
    assert worst == [5, 1]


# ------------------------------------------------------------------ targets


def test_target_modes(g):
    newest = by(targets.targets_asof(g.goals), "content_id")
    assert (newest[1].goal_id, newest[4].goal_id, newest[5].goal_id) == (3, 5, 6)
    begun = by(targets.targets_asof(g.goals, as_of=date(2026, 5, 31)), "content_id")
    assert begun[1].goal_id == 2
    ties = targets.targets_asof(g.goals, mode="latest_ties").collect()
    assert sorted(r.goal_id for r in ties) == [3, 4, 5, 6]
    assert targets.targets_asof(g.goals, as_of=date(2026, 5, 31), mode="all").count() == 5
    with pytest.raises(ValueError):
        targets.targets_asof(g.goals, mode="first")
    looked_up = targets.target_lookup(g.content, g.goals, [1, 2]).collect()
    assert [(r.content_id, r.target_clear_rate) for r in looked_up] == [
        (1, D("52.00")), (1, D("60.00")), (1, D("70.00")), (2, None)]


# ------------------------------------------------------------------ eligibility and gaps


def test_eligibility(g):
    # Active in May and live: 1, 2, 4, 8, 9 and 5; character 9 is under level.
    rows = by(eligibility.eligible_by_content(g.activity, g.characters, g.content, *MAY), "content_id")
    assert set(rows) == {1, 2, 4, 5}
    assert [rows[i].eligible_character_count for i in (1, 2, 4, 5)] == [5, 5, 5, 5]
    assert [rows[i].recommended_ready_character_count for i in (1, 2, 4, 5)] == [3, 5, 5, 0]
    everyone = by(eligibility.eligible_characters(g.content, g.characters), "content_id")
    assert (everyone[1].eligible_character_count_100, everyone[1].eligible_character_count_80) == (5, 7)
    assert (everyone[5].eligible_character_count_100, everyone[5].eligible_character_count_80) == (0, 0)


def test_gap(g):
    df = gap.health_gap(g.attempts, g.activity, g.characters, g.content, g.goals, g.rewards, *MAY)
    assert len(df.columns) == 33
    rows = by(df, "content_id")
    assert set(rows) == {1, 2, 4, 5}
    one = rows[1]
    assert (one.total_attempt_count, one.participant_character_count) == (6, 5)
    assert (one.participation_rate, one.participation_gap) == (D("100.00"), D("50.00"))
    assert (one.clear_rate, one.clear_rate_gap, one.retry_rate) == (D("33.33"), D("-26.67"), D("20.00"))
    assert one.reward_claim_rate == D("100.00")  # claimed per clear
    assert one.avg_reward_value == D("2396.67")  # 300, 60, 10, 10, 7000, 7000 with one missing value
    assert one.health_status == "LOW_CLEAR_RATE"
    assert (rows[2].health_status, rows[2].clear_rate, rows[2].total_attempt_count) == ("NO_DATA", None, 0)
    assert rows[5].health_status == "NO_DATA"  # its only attempt is outside the window
    assert rows[4].target_clear_rate == D("20.00") and rows[4].health_status == "NORMAL"
    assert [r.health_status for r in df.collect()] == ["LOW_CLEAR_RATE", "NO_DATA", "NO_DATA", "NORMAL"]


def test_gap_statuses_follow_in_order(spark, g):
    def status(**goal):
        base = {"content_id": 1, "difficulty": "hard", "valid_from": date(2026, 1, 1),
                "target_participation_rate": D("0.00"), "target_clear_rate": D("0.00"),
                "target_avg_clear_time_sec": 1000, "target_death_count_avg": D("9.00")}
        one = game.make(spark, "content_design_goals", [{**base, **goal}])
        df = gap.health_gap(g.attempts, g.activity, g.characters, g.content, one, g.rewards, *MAY)
        return by(df, "content_id")[1].health_status

    assert status() == "NORMAL"
    assert status(target_participation_rate=D("143.00"), target_clear_rate=D("99.00")) == "LOW_PARTICIPATION"
    assert status(target_clear_rate=D("48.34")) == "LOW_CLEAR_RATE"  # 33.333… is below 33.34
    assert status(target_clear_rate=D("48.33")) == "NORMAL"
    assert status(target_avg_clear_time_sec=69) == "LONG_CLEAR_TIME"
    assert status(target_death_count_avg=D("2.22")) == "HIGH_DEATH_COUNT"


def test_gap_versions_fan_out_only_on_request(g):
    args = (g.attempts, g.activity, g.characters, g.content, g.goals, g.rewards, *MAY)
    assert gap.health_gap(*args, target_mode="all").filter("content_id = 1").count() == 2
    assert gap.health_gap(*args).filter("content_id = 1").count() == 1


# ------------------------------------------------------------------ usage


def test_population_in_period(g):
    # The attempts run from 2026-05-10 to 2026-06-20; character 10 is deleted, 5 never played.
    row = usage.active_population(g.activity, g.characters, g.attempts).first()
    assert (row.active_account_count, row.active_character_count) == (4, 5)


def test_usage(g):
    df = usage.usage_overview(g.attempts, g.activity, g.characters, g.content, g.goals)
    assert len(df.columns) == 56
    rows = by(df, "content_id")
    assert set(rows) == {1, 2, 4, 5}
    one, two = rows[1], rows[2]
    assert (one.attempt_count, one.party_count, one.non_clear_count) == (6, 1, 4)
    assert one.account_participation_rate_pct == D("100.00") and one.attempt_share_pct == D("75.00")
    assert one.avg_attempts_per_participant_account == D("1.50")
    assert (one.content_line_name, one.difficulty_order) == ("Cave", 3)
    assert (two.attempt_count, two.clear_rate_pct, two.avg_attempts_per_participant_account) == (0, D("0.00"), D("0.00"))
    assert two.participation_status == "UNUSED" and two.avg_death_count is None
    assert (one.peer_attempt_gap, one.peer_attempt_rank, rows[5].peer_attempt_rank) == (D("2.50"), 1, 2)
    # Attempts 6, 1, 1, 0: a tie shares the rank and the next one is skipped.
    assert [rows[i].total_attempt_rank for i in (1, 4, 5, 2)] == [1, 2, 2, 4]
    assert one.usage_failure_segment == "HIGH_USE_HIGH_FAILURE"
    assert two.usage_failure_segment == "LOW_USE_LOW_FAILURE"
    assert [r.content_id for r in usage.select_below_target(df).collect()] == [1, 5]


def test_usage_without_population(g):
    df = usage.usage_overview(g.attempts, g.activity.limit(0), g.characters, g.content, g.goals)
    row = by(df, "content_id")[1]
    assert row.active_account_count == 0 and row.account_participation_rate_pct is None
    assert row.usage_failure_segment == "OTHER"


# ------------------------------------------------------------------ difficulty, participation, segments


def test_difficulty(g):
    df = difficulty.difficulty_factors(g.attempts, g.content, g.goals)
    rows = by(df, "content_id")
    assert set(rows) == {1, 4, 5}  # content 3 has no goal
    # Fail rates of the hard contents: 33.33 and 100; their mean is 66.67.
    assert rows[5].difficulty_avg_fail_rate_pct == D("66.67") and rows[5].fail_rate_gap_pp == D("33.33")
    assert (rows[5].fail_rate_flag, rows[5].death_count_flag, rows[5].clear_time_flag) == (1, 1, 0)
    assert rows[5].difficulty_verdict == "DIFFICULTY_LIKELY"
    assert (rows[1].fail_rate_flag, rows[1].death_count_flag) == (0, 1)
    assert rows[1].difficulty_verdict == "DIFFICULTY_POSSIBLE"
    assert rows[4].difficulty_verdict == "DIFFICULTY_UNLIKELY"
    # Choosing contents does not change their peers.
    chosen = by(difficulty.difficulty_factors(g.attempts, g.content, g.goals, [5]), "content_id")
    assert set(chosen) == {5} and chosen[5] == rows[5]
    below = g.content.filter("content_id = 5")
    assert by(difficulty.difficulty_factors(g.attempts, g.content, g.goals, below), "content_id") == chosen


def test_participation(g):
    rows = by(participation.eligible_participation(g.attempts, g.content, g.characters), "content_id")
    assert set(rows) == {1, 2, 4, 5}
    one = rows[1]
    # The deleted challenger is left out: 5 attempts by characters 1, 2, 4 and 8.
    assert (one.total_attempt_count, one.actual_attempt_character_count) == (5, 4)
    assert (one.actual_attempt_character_count_100, one.actual_attempt_character_count_80) == (2, 3)
    assert one.actual_attempt_character_count_under_80 == 1
    assert one.participation_rate_100_pct == D("40.00") and one.participation_rate_80_pct == D("42.86")
    assert one.avg_attempts_per_character == D("1.25")
    five = rows[5]
    assert (five.eligible_character_count_80, five.participation_rate_80_pct) == (0, None)
    assert five.actual_attempt_character_count_under_80 == 1  # under level, though strong enough
    # The peer mean skips the content without eligible characters.
    assert one.difficulty_avg_participation_rate_80_pct == D("42.86")
    assert one.difficulty_avg_attempt_count == D("3") and one.attempt_count_gap == D("2")
    assert five.participation_verdict == "MANY_UNDER_POWERED"
    assert one.participation_verdict == "HEALTHY"
    assert rows[2].participation_verdict == "HEALTHY"  # 0 of 9 is its own peer mean


def test_segments(g):
    df = segments.power_segments(g.attempts, g.characters, g.content, g.goals)
    rows = [(r.content_id, r.party_size, r.power_band, r.attempt_count, r.character_count, r.clear_rate_pct) for r in df.collect()]
    assert rows == [
        (1, "1인", "03_100_to_110", 1, 1, D("0.00")),
        (1, "1인", "05_120_and_over", 1, 1, D("0.00")),
        (1, "4인", "01_under_80", 2, 1, D("50.00")),
        (1, "4인", "05_120_and_over", 1, 1, D("0.00")),
        (5, "2인", "05_120_and_over", 1, 1, D("0.00")),
    ]
    every = segments.power_segments(g.attempts, g.characters, g.content, g.goals, [1], target_mode="all")
    assert every.filter("power_band = '03_100_to_110'").count() == 3
    # Without a recommended power the ratio is unknown and the top band is used.
    generous = g.goals.selectExpr("* EXCEPT (target_clear_rate)", "CAST(101 AS DECIMAL(5,2)) AS target_clear_rate")
    field = segments.power_segments(g.attempts, g.characters, g.content, generous, [4]).collect()
    assert [r.power_band for r in field] == ["05_120_and_over"]


def test_band_performance(g):
    rows = by(segments.band_performance(g.attempts, g.characters, g.content, g.goals, 1), "power_band")
    assert {k: v.attempt_count for k, v in rows.items()} == {
        "01_under_80": 2, "02_80_to_100": 1, "03_100_to_110": 1, "05_120_and_over": 2}
    low = rows["01_under_80"]
    assert (low.character_count, low.avg_combat_power, low.avg_power_ratio_pct) == (1, D("799"), D("79.90"))
    assert (low.clear_rate_pct, low.clear_rate_gap_pp) == (D("50.00"), D("-20.00"))
    assert (low.avg_death_count, low.death_count_gap) == (D("3.00"), D("1.00"))
    assert (low.avg_clear_time_sec, low.clear_time_gap_sec) == (D("90.00"), D("-10.00"))
    assert rows["05_120_and_over"].avg_combat_power == D("3100")
    assert rows["02_80_to_100"].avg_clear_time_sec is None


# ------------------------------------------------------------------ rewards


def test_reward_by_result(g):
    df = rewards.reward_by_result(g.attempts, g.rewards, 1)
    rows = by(df, "result")
    clear, fail = rows["clear"], rows["fail"]
    assert (clear.attempt_count, clear.attempt_share_pct) == (2, D("33.33"))
    # Attempt 1 has 3 items worth 300 from rewards tagged with the content, attempt 3 nothing.
    assert (clear.avg_reward_quantity, clear.avg_reward_value) == (D("1.50"), D("150.00"))
    assert clear.avg_reward_value_when_paid == D("300.00")
    assert clear.avg_reward_value_per_minute == D("200.00")  # 300 in 90 s; no duration is skipped
    assert clear.avg_duration_sec == D("90.00")
    assert fail.avg_duration_sec == D("180.00") and fail.avg_reward_value_per_minute == D("11.00")  # 12 and 10
    assert rows["disconnect"].avg_reward_value_per_minute is None  # zero seconds
    assert rows["give_up"].avg_reward_value_per_minute == D("-10.00")  # ends before it starts
    assert [r.result for r in df.collect()] == ["clear", "fail", "disconnect", "give_up"]
    known = rewards.reward_by_result(g.attempts, g.rewards, 1, g.characters.filter("character_id <> 1"))
    assert by(known, "result")["clear"].attempt_count == 1


def test_reward_by_tier_and_line(g):
    tier = by(rewards.reward_by_tier(g.attempts, g.rewards, g.content, "hard"), "content_id")
    assert set(tier) == {1, 3, 5}
    one = tier[1]
    # All rewards of an attempt count here, whatever content they name: 1300 for attempt 1.
    assert one.avg_reward_value_per_clear == D("650.00")
    assert one.avg_reward_value == D("230.00")  # (1300 + 60 + 0 + 10 + 0 + 10) / 6
    assert one.clear_reward_value_per_minute == D("866.67")
    line = rewards.reward_by_line(g.attempts, g.rewards, g.content, "Cave").collect()
    assert [r.content_id for r in line] == [1]
    ids = rewards.reward_by_line(g.attempts, g.rewards, g.content, [4, 5, 1]).collect()
    assert [r.content_id for r in ids] == [4, 1, 5]  # normal, then hard
    assert ids[0].clear_reward_value_per_minute is None  # a clear in zero seconds


# ------------------------------------------------------------------ one content


def test_release(spark, g):
    row = release.release_maturity(g.attempts, g.content, g.goals, 1).first()
    assert (row.days_since_release, row.release_stage, row.clear_rate_gap_pp) == (39, "SETTLING", D("-36.67"))
    assert release.release_maturity(g.attempts, g.content, g.goals, 5).first().days_since_release == 80
    for days, stage in ((29, "OBSERVE"), (30, "SETTLING"), (89, "SETTLING"), (90, "SETTLED")):
        moved = g.content.selectExpr("* EXCEPT (release_date)", f"date_sub(DATE'2026-05-10', {days}) AS release_date")
        assert release.release_maturity(g.attempts, moved, g.goals, 1).first().release_stage == stage


def test_pattern_impact(g):
    df = patterns.pattern_impact(g.patterns, g.attempts, 1)
    rows = by(df, "phase_no", "pattern_code")
    assert set(rows) == {(1, "P1"), (2, "P1"), (2, "P2"), (1, "P3")}
    p1 = rows[(1, "P1")]
    assert (p1.exposed_attempt_count, p1.hit_attempt_count, p1.hit_rate_pct) == (3, 2, D("66.67"))
    assert p1.avg_damage_when_hit == D("27.50")  # mean of 15 and 40
    assert (p1.fail_rate_pct, p1.fail_rate_hit_pct, p1.fail_rate_avoided_pct) == (D("33.33"), D("50.00"), D("0.00"))
    assert p1.fail_rate_difference_pp == D("50.00")
    p2 = rows[(2, "P2")]
    assert (p2.hit_rate_pct, p2.fail_rate_avoided_pct, p2.fail_rate_difference_pp) == (D("100.00"), None, None)
    assert rows[(1, "P3")].avg_damage_when_hit is None and rows[(1, "P3")].fail_rate_hit_pct is None
    assert df.collect()[0].pattern_code == "P1"  # no difference sorts last


def test_pattern_by_result(g):
    rows = by(patterns.pattern_by_result(g.patterns, g.attempts, 1, "P1"), "result")
    assert (rows["clear"].pattern_attempt_count, rows["clear"].pattern_log_count) == (2, 4)
    assert (rows["clear"].hit_log_count, rows["clear"].avg_damage) == (2, D("7.50"))
    assert (rows["fail"].pattern_log_count, rows["fail"].fatal_share_pct) == (2, D("50.00"))


def test_pattern_incidence(g):
    rows = by(patterns.pattern_incidence_by_band(g.attempts, g.characters, g.content, g.patterns, 1, "P1"), "power_band")
    low = rows["01_under_80"]
    assert (low.attempt_count, low.fail_count, low.pattern_attempt_count) == (2, 1, 2)
    assert (low.pattern_rate_pct, low.pattern_per_fail_pct) == (D("100.00"), D("200.00"))
    assert rows["02_80_to_100"].pattern_per_fail_pct is None  # no fails
    assert rows["05_120_and_over"].pattern_attempt_count == 0


# ------------------------------------------------------------------ options


@pytest.mark.parametrize("collation", ["UTF8_LCASE", "UNICODE_CI_AI"])
def test_collation_ignores_case(g, collation):
    shouted = g.attempts.withColumn("result", F.upper("result"))
    assert health.content_health(shouted, g.content).agg(F.sum("clear_attempt_count")).first()[0] == 0
    loose = [with_collation(df, collation) for df in (shouted, g.characters, g.content, g.goals)]
    counted = health.content_health(loose[0], loose[2])
    assert by(counted, "content_id")[1].clear_rate_pct == D("33.33")
    df = usage.usage_overview(loose[0], g.activity, loose[1], loose[2], loose[3])
    assert by(df, "content_id")[1].content_line_name == "Cave"
    assert by(df, "content_id")[1].target_clear_rate == D("70.00")


def test_estimated_participants(g):
    exact = by(health.content_health(g.attempts, g.content), "content_id")
    near = by(health.content_health(g.attempts, g.content, max_error=0.01), "content_id")
    assert {k: v.participant_character_count for k, v in near.items()} == {
        k: v.participant_character_count for k, v in exact.items()}  # exact for so few
    assert by(profile.daily_kpis(g.activity, max_error=0.01), "activity_date")[date(2026, 5, 13)].dau == 2
