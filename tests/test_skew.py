"""Generated tables with hot keys against a plain restatement on the same rows.

One content and one character hold about a third of the attempts each, one
attempt a third of the rewards, and many rewards have no attempt at all.
"""

from datetime import date

import pytest
from pyspark.sql import functions as F

from playgauge.operators import eligibility, gap, health, participation, patterns, profile, rewards, segments, usage

N = 30_000
RESULTS = ("clear", "fail", "give_up", "disconnect")


def spread(seed, modulus):
    return F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(modulus))


def hot(seed, value, otherwise):
    return F.when(spread(seed, 3) == 0, F.lit(value)).otherwise(otherwise)


@pytest.fixture(scope="module")
def t(spark):
    day0 = F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")
    attempts = spark.range(N).select(
        F.col("id").alias("attempt_id"),
        hot(1, 3, spread(2, 700)).alias("account_id"),
        hot(3, 5, spread(4, 900)).alias("character_id"),
        hot(5, 7, spread(6, 20)).alias("content_id"),
        F.when(spread(7, 4) > 0, spread(8, 5000)).alias("party_id"),
        (day0 + F.make_dt_interval(days=spread(9, 120).cast("int"))).alias("attempt_started_at"),
        (day0 + F.make_dt_interval(days=F.lit(200))).alias("attempt_ended_at"),
        F.element_at(F.array(*map(F.lit, RESULTS)), (spread(10, 4) + 1).cast("int")).alias("result"),
        F.when(spread(11, 5) > 0, spread(12, 2000)).cast("int").alias("clear_time_sec"),
        spread(13, 9).cast("int").alias("death_count"),
        spread(14, 3).cast("int").alias("revive_count"),
        spread(15, 20).cast("int").alias("potion_used_count"),
        (spread(16, 4) + 1).cast("int").alias("party_member_count"),
        spread(17, 2).cast("int").alias("reward_claimed"),
    )
    frames = {
        "attempts": attempts,
        "characters": spark.range(900).select(
            F.col("id").alias("character_id"),
            spread(20, 60).cast("int").alias("level"),
            spread(21, 5000).alias("combat_power"),
            (spread(22, 10) == 0).cast("int").alias("is_deleted"),
        ),
        "content": spark.range(22).select(
            F.col("id").alias("content_id"),
            F.concat(F.lit("C"), F.col("id")).alias("content_name"),
            F.lit("raid").alias("content_type"),
            F.element_at(F.array(*map(F.lit, ("easy", "hard"))), (F.col("id") % 2 + 1).cast("int")).alias("difficulty"),
            spread(23, 50).cast("int").alias("required_level"),
            (spread(24, 4000) + 1).alias("recommended_combat_power"),
            F.lit(1).alias("min_party_size"),
            F.lit(4).alias("max_party_size"),
            F.lit(100).alias("expected_clear_time_sec"),
            (F.col("id") != 4).cast("int").alias("is_active"),
        ),
        "rewards": spark.range(N).select(
            F.when(spread(30, 3) == 0, F.lit(11)).when(spread(31, 3) > 0, spread(32, N)).alias("attempt_id"),
            hot(33, 7, spread(34, 20)).alias("content_id"),
            spread(35, 5).cast("int").alias("quantity"),
            F.when(spread(36, 6) > 0, spread(37, 10_000)).alias("estimated_gold_value"),
        ),
        "patterns": spark.range(2 * N).select(
            hot(40, 11, spread(41, N)).alias("attempt_id"),
            F.lit(7).alias("content_id"),
            (spread(42, 3) + 1).cast("int").alias("phase_no"),
            hot(43, "P1", F.concat(F.lit("P"), spread(44, 5))).alias("pattern_code"),
            F.lit("name").alias("pattern_name"),
            spread(45, 2).cast("int").alias("was_hit"),
            spread(46, 2).cast("int").alias("is_fatal"),
            spread(47, 1000).alias("damage_taken"),
        ),
    }
    frames = {name: df.cache() for name, df in frames.items()}
    for name, df in frames.items():
        df.createOrReplaceTempView(name)
    yield frames
    for df in frames.values():
        df.unpersist()


def same(got, expected):
    columns = sorted(expected.columns)
    left = got.select(columns)
    assert left.count() == expected.count() > 0
    cast = [F.col(c).cast("double").alias(c) if dict(expected.dtypes)[c] != "string" else F.col(c) for c in columns]
    a, b = left.select(cast), expected.select(cast)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_distinct_counts(spark, t):
    same(
        health.content_health(t["attempts"], t["content"]),
        spark.sql(
            "SELECT content_id, count(*) total_attempt_count, count(DISTINCT account_id) participant_account_count,"
            " count(DISTINCT character_id) participant_character_count FROM attempts JOIN content USING (content_id)"
            " GROUP BY content_id"
        ),
    )
    same(
        usage.usage_facts(t["attempts"]),
        spark.sql("SELECT content_id, count(DISTINCT party_id) party_count FROM attempts GROUP BY content_id"),
    )
    same(
        profile.overall_summary(t["attempts"]),
        spark.sql("SELECT count(DISTINCT date(attempt_started_at)) date_count, count(*) total_attempt_count FROM attempts"),
    )


def test_repeat_participants(spark, t):
    window = (date(2026, 2, 1), date(2026, 3, 15))
    same(
        gap.attempt_summary(t["attempts"], *window),
        spark.sql(
            "SELECT content_id, sum(n) total_attempt_count, count(*) participant_character_count,"
            " count_if(n >= 2) retry_character_count FROM (SELECT content_id, character_id, count(*) n FROM attempts"
            " WHERE date(attempt_started_at) BETWEEN DATE'2026-02-01' AND DATE'2026-03-15' GROUP BY ALL) GROUP BY content_id"
        ),
    )


def test_threshold_counts(spark, t):
    same(
        eligibility.eligible_characters(t["content"], t["characters"]),
        spark.sql(
            "SELECT content_id,"
            " count_if(level >= required_level AND combat_power >= recommended_combat_power) eligible_character_count_100,"
            " count_if(level >= required_level AND combat_power >= recommended_combat_power * 0.8) eligible_character_count_80"
            " FROM content CROSS JOIN characters WHERE is_active = 1 AND is_deleted = 0 GROUP BY content_id"
        ),
    )


def test_threshold_counts_at_the_edges(spark):
    content = spark.createDataFrame(
        [(1, 5, 100), (2, 5, 100), (3, None, 100), (4, 1, None), (5, 99, 1)], "content_id long, required_level int, recommended_combat_power long"
    )
    characters = spark.createDataFrame(
        [(5, 100), (4, 100), (5, 99), (None, 500), (50, None), (1, 0)], "level int, combat_power long"
    )
    got = {
        r.content_id: (r.entry, r.full)
        for r in eligibility.threshold_counts(content, characters, {"entry": None, "full": 1}).collect()
    }
    assert got == {1: (3, 1), 2: (3, 1), 3: (0, 0), 4: (5, 0), 5: (0, 0)}
    none = eligibility.threshold_counts(content, characters.limit(0), {"entry": None, "full": 1}).collect()
    assert len(none) == 5 and all((r.entry, r.full) == (0, 0) for r in none)
    assert eligibility.threshold_counts(content.limit(0), characters, {"entry": None}).count() == 0


def test_challengers(spark, t):
    same(
        participation.challengers(t["attempts"], t["content"], t["characters"]),
        spark.sql(
            "SELECT content_id, count(*) total_attempt_count,"
            " count(DISTINCT character_id) actual_attempt_character_count,"
            " count(DISTINCT CASE WHEN level >= required_level AND combat_power >= recommended_combat_power THEN character_id END)"
            "   actual_attempt_character_count_100,"
            " count(DISTINCT CASE WHEN level < required_level OR combat_power < recommended_combat_power * 0.8 THEN character_id END)"
            "   actual_attempt_character_count_under_80"
            " FROM attempts JOIN characters USING (character_id) JOIN content USING (content_id)"
            " WHERE is_deleted = 0 GROUP BY content_id"
        ),
    )


def test_segments(spark, t):
    goals = spark.sql(
        "SELECT content_id AS goal_id, content_id, difficulty, CAST(100 AS DECIMAL(5,2)) AS target_clear_rate,"
        " DATE'2026-01-01' AS valid_from FROM content"
    )
    got = segments.power_segments(t["attempts"], t["characters"], t["content"], goals, party_suffix="")
    same(
        got,
        spark.sql(
            "SELECT * FROM (SELECT content_id, CAST(party_member_count AS STRING) party_size,"
            " CASE WHEN combat_power < recommended_combat_power * 0.8 THEN '01_under_80'"
            " WHEN combat_power < recommended_combat_power THEN '02_80_to_100'"
            " WHEN combat_power < recommended_combat_power * 1.1 THEN '03_100_to_110'"
            " WHEN combat_power < recommended_combat_power * 1.2 THEN '04_110_to_120' ELSE '05_120_and_over' END power_band,"
            " count(*) attempt_count, count(DISTINCT character_id) character_count, count_if(result = 'clear') clear_count"
            " FROM attempts JOIN characters USING (character_id) JOIN content USING (content_id) GROUP BY ALL)"
            " WHERE clear_count < attempt_count"
        ),
    )


def test_rewards(spark, t):
    same(
        rewards.reward_by_tier(t["attempts"], t["rewards"], t["content"], "hard"),
        spark.sql(
            "SELECT content_id, count(*) attempt_count, round(CAST(sum(coalesce(v, 0)) / count(*) AS DECIMAL(20,8)), 2) avg_reward_value"
            " FROM attempts LEFT JOIN (SELECT attempt_id, sum(estimated_gold_value) v FROM rewards GROUP BY attempt_id)"
            " USING (attempt_id) JOIN content USING (content_id) WHERE difficulty = 'hard' GROUP BY content_id"
        ),
    )


def test_patterns(spark, t):
    same(
        patterns.pattern_impact(t["patterns"], t["attempts"], 7),
        spark.sql(
            "SELECT phase_no, pattern_code, count(*) exposed_attempt_count, sum(hit) hit_attempt_count,"
            " sum(fatal) fatal_attempt_count FROM (SELECT p.attempt_id, phase_no, pattern_code, max(was_hit) hit,"
            " max(is_fatal) fatal FROM patterns p JOIN attempts a ON a.attempt_id = p.attempt_id"
            " WHERE a.content_id = 7 GROUP BY ALL) GROUP BY ALL"
        ),
    )
    same(
        patterns.pattern_by_result(t["patterns"], t["attempts"], 7, "P1"),
        spark.sql(
            "SELECT result, count(DISTINCT p.attempt_id) pattern_attempt_count, count(*) pattern_log_count,"
            " sum(was_hit) hit_log_count FROM patterns p JOIN attempts a ON a.attempt_id = p.attempt_id"
            " WHERE pattern_code = 'P1' GROUP BY result"
        ),
    )


def test_counts_add_up(t):
    h = health.content_health(t["attempts"], t["content"])
    parts = ["clear_attempt_count", "fail_attempt_count", "give_up_attempt_count", "disconnect_attempt_count"]
    assert h.filter(sum(F.col(p) for p in parts) != F.col("total_attempt_count")).isEmpty()
    c = participation.challengers(t["attempts"], t["content"], t["characters"])
    assert c.filter(
        F.col("actual_attempt_character_count_80") + F.col("actual_attempt_character_count_under_80")
        != F.col("actual_attempt_character_count")
    ).isEmpty()
