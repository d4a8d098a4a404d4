"""Boss patterns: exposure, hits, and what they do to the fail rate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playgauge.config import DEFAULT, Outcomes, Settings
from playgauge.functions.classify import power_band
from playgauge.functions.counting import outcome_counts
from playgauge.functions.exact import mean, mean_of, percent, rate_pct, rounded


def pattern_attempts(patterns: DataFrame, attempts: DataFrame, content_id: int, outcomes: Outcomes) -> DataFrame:
    """One row per attempt, pattern and phase: hit at all, fatal at all, mean damage, failed.

    Logs shrink to this grain before the attempts join.
    """
    hit_damage = F.when(F.col("was_hit") == 1, F.col("damage_taken"))
    per_attempt = (
        patterns.filter(F.col("content_id") == content_id)
        .groupBy("attempt_id", "pattern_code", "pattern_name", "phase_no")
        .agg(
            F.max("was_hit").alias("was_hit"),
            F.max("is_fatal").alias("is_fatal"),
            F.sum("damage_taken").alias("total_damage_taken"),
            mean_of(hit_damage).cast("decimal(24,8)").alias("avg_damage_when_hit"),
        )
    )
    known = attempts.filter(F.col("content_id") == content_id).select("attempt_id", "result")
    return per_attempt.join(known, "attempt_id").withColumn("failed", F.col("result") == outcomes.fail)


def pattern_impact(
    patterns: DataFrame, attempts: DataFrame, content_id: int, outcomes: Outcomes = DEFAULT.outcomes
) -> DataFrame:
    """Per phase and pattern: hit and fatal shares, damage, and fail rates hit against avoided.

    A pattern that always hits has no avoided fail rate and no difference.
    """
    hit, avoided, failed = F.col("was_hit") == 1, F.col("was_hit") == 0, F.col("failed")
    grouped = (
        pattern_attempts(patterns, attempts, content_id, outcomes)
        .groupBy("phase_no", "pattern_code", "pattern_name")
        .agg(
            F.count("*").alias("exposed_attempt_count"),
            F.count_if(hit).alias("hit_attempt_count"),
            F.count_if(F.col("is_fatal") == 1).alias("fatal_attempt_count"),
            rounded(F.avg("avg_damage_when_hit")).alias("avg_damage_when_hit"),
            F.count_if(failed).alias("_failed"),
            F.count_if(avoided).alias("_avoided"),
            F.count_if(hit & failed).alias("_hit_failed"),
            F.count_if(avoided & failed).alias("_avoided_failed"),
        )
    )
    fail_hit, fail_avoided = percent("_hit_failed", "hit_attempt_count"), percent("_avoided_failed", "_avoided")
    return grouped.select(
        "phase_no",
        "pattern_code",
        "pattern_name",
        "exposed_attempt_count",
        "hit_attempt_count",
        rate_pct("hit_attempt_count", "exposed_attempt_count").alias("hit_rate_pct"),
        "fatal_attempt_count",
        rate_pct("fatal_attempt_count", "exposed_attempt_count").alias("fatal_share_pct"),
        "avg_damage_when_hit",
        rate_pct("_failed", "exposed_attempt_count").alias("fail_rate_pct"),
        rounded(fail_hit).alias("fail_rate_hit_pct"),
        rounded(fail_avoided).alias("fail_rate_avoided_pct"),
        rounded(fail_hit - fail_avoided).alias("fail_rate_difference_pp"),
    ).orderBy(
        F.col("fail_rate_difference_pp").desc(),
        F.col("fatal_share_pct").desc(),
        F.col("hit_rate_pct").desc(),
        "phase_no",
        "pattern_code",
    )


def pattern_by_result(patterns: DataFrame, attempts: DataFrame, content_id: int, code: str) -> DataFrame:
    """One pattern by attempt result, counted on log rows; damage includes misses."""
    per_attempt = (
        patterns.filter((F.col("content_id") == content_id) & (F.col("pattern_code") == code))
        .groupBy("attempt_id")
        .agg(
            F.count("*").alias("logs"),
            F.count_if(F.col("was_hit") == 1).alias("hits"),
            F.count_if(F.col("is_fatal") == 1).alias("fatals"),
            F.sum("damage_taken").alias("damage"),
            F.count("damage_taken").alias("damage_n"),
        )
    )
    return (
        per_attempt.join(attempts.select("attempt_id", "result"), "attempt_id")
        .groupBy("result")
        .agg(
            F.count("*").alias("pattern_attempt_count"),
            F.sum("logs").alias("pattern_log_count"),
            F.sum("hits").alias("hit_log_count"),
            rate_pct(F.sum("hits"), F.sum("logs")).alias("hit_rate_pct"),
            F.sum("fatals").alias("fatal_log_count"),
            rate_pct(F.sum("fatals"), F.sum("logs")).alias("fatal_share_pct"),
            rounded(mean(F.sum("damage"), F.sum("damage_n"))).alias("avg_damage"),
        )
        .orderBy(F.col("pattern_attempt_count").desc(), "result")
    )


def pattern_incidence_by_band(
    attempts: DataFrame,
    characters: DataFrame,
    content: DataFrame,
    patterns: DataFrame,
    content_id: int,
    code: str,
    settings: Settings = DEFAULT,
) -> DataFrame:
    """How often one pattern occurs, by power band.

    The share per failed attempt divides all incident attempts, failed or not,
    by the failed attempts.
    """
    incident = (
        patterns.filter((F.col("content_id") == content_id) & (F.col("pattern_code") == code))
        .select("attempt_id")
        .distinct()
        .withColumn("incident", F.lit(True))
    )
    per_character = (
        attempts.filter(F.col("content_id") == content_id)
        .select("attempt_id", "content_id", "character_id", "result")
        .join(incident, "attempt_id", "left")
        .groupBy("content_id", "character_id")
        .agg(
            F.count("*").alias("n"),
            F.count("incident").alias("incidents"),
            *outcome_counts({"clear": "clears", "fail": "fails"}, settings.outcomes),
        )
    )
    counted = (
        per_character.join(content.select("content_id", "recommended_combat_power"), "content_id")
        .join(characters.select("character_id", "combat_power"), "character_id")
        .groupBy(power_band("combat_power", "recommended_combat_power", settings.bands).alias("power_band"))
        .agg(
            F.sum("n").alias("attempt_count"),
            F.sum("fails").alias("fail_count"),
            F.sum("incidents").alias("pattern_attempt_count"),
            F.sum("clears").alias("_clears"),
        )
    )
    return counted.select(
        "power_band",
        "attempt_count",
        "fail_count",
        "pattern_attempt_count",
        rate_pct("pattern_attempt_count", "attempt_count").alias("pattern_rate_pct"),
        rate_pct("pattern_attempt_count", "fail_count").alias("pattern_per_fail_pct"),
        rate_pct("_clears", "attempt_count").alias("clear_rate_pct"),
        rate_pct("fail_count", "attempt_count").alias("fail_rate_pct"),
    ).orderBy("power_band")
