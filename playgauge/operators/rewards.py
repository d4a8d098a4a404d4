"""Reward efficiency: what attempts pay, per attempt, per clear and per minute."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playgauge.config import DEFAULT, Outcomes
from playgauge.functions.classify import difficulty_order, line_name
from playgauge.functions.counting import outcome_counts
from playgauge.functions.exact import mean, mean_of, per_minute, rate_pct, rounded
from playgauge.functions.period import attempt_duration

_OUTCOMES = ("clear", "fail", "give_up", "disconnect")


def rewards_per_attempt(rewards: DataFrame) -> DataFrame:
    """Reward rows, quantity and value per attempt; rewards outside attempts are left out.

    Rewards without an attempt join nothing, so they are dropped before the
    shuffle instead of meeting in one task.
    """
    return (
        rewards.filter(F.col("attempt_id").isNotNull())
        .groupBy("attempt_id")
        .agg(
            F.count("*").alias("reward_row_count"),
            F.sum("quantity").alias("reward_quantity"),
            F.sum("estimated_gold_value").alias("reward_value"),
        )
    )


def _timed(attempts: DataFrame) -> DataFrame:
    return attempts.select(
        "attempt_id",
        "content_id",
        "character_id",
        "result",
        "clear_time_sec",
        "death_count",
        "reward_claimed",
        attempt_duration().alias("duration_sec"),
    )


def reward_by_result(
    attempts: DataFrame,
    rewards: DataFrame,
    content_id: int,
    characters: DataFrame | None = None,
) -> DataFrame:
    """Reward efficiency of one content by attempt result.

    Only rewards tagged with the content count. With ``characters`` given,
    attempts of unknown characters are left out. Attempts are summed per result
    and character first, so a very active character joins as a few rows.
    """
    paid = rewards_per_attempt(rewards.filter(F.col("content_id") == content_id))
    value = F.coalesce(F.col("reward_value"), F.lit(0))
    measures = {
        "deaths": F.col("death_count"),
        "seconds": F.col("duration_sec"),
        "quantity": F.coalesce(F.col("reward_quantity"), F.lit(0)),
        "value": value,
        "paid": F.col("reward_value"),
        "minute": per_minute(value, "duration_sec"),
    }
    per_character = (
        _timed(attempts.filter(F.col("content_id") == content_id))
        .join(paid, "attempt_id", "left")
        .groupBy("result", "character_id")
        .agg(
            F.count("*").alias("n"),
            F.count_if(F.col("reward_claimed") == 1).alias("claimed"),
            *(F.sum(m).alias(name) for name, m in measures.items()),
            *(F.count(m).alias(f"{name}_n") for name, m in measures.items()),
        )
    )
    if characters is not None:
        per_character = per_character.join(characters.select("character_id"), "character_id", "left_semi")

    def average(name: str) -> Column:
        return rounded(mean(F.sum(name), F.sum(f"{name}_n")))

    per_minute_mean = F.sum("minute").cast("decimal(28,8)") / F.nullif(
        F.sum("minute_n").cast("decimal(18,0)"), F.lit(0)
    )
    grouped = per_character.groupBy("result").agg(
        F.sum("n").alias("attempt_count"),
        F.count("character_id").alias("character_count"),
        average("deaths").alias("avg_death_count"),
        average("seconds").alias("avg_duration_sec"),
        F.sum("claimed").alias("reward_claimed_count"),
        average("quantity").alias("avg_reward_quantity"),
        average("value").alias("avg_reward_value"),
        average("paid").alias("avg_reward_value_when_paid"),
        rounded(per_minute_mean).alias("avg_reward_value_per_minute"),
    )
    everything = F.sum("attempt_count").over(Window.partitionBy())
    return grouped.select(
        "result",
        "attempt_count",
        "character_count",
        rate_pct("attempt_count", everything).alias("attempt_share_pct"),
        *grouped.columns[3:],
    ).orderBy(F.col("attempt_count").desc(), "result")


def _paid_attempts(attempts: DataFrame, rewards: DataFrame, content: DataFrame) -> DataFrame:
    """Attempts of the given contents with the value of all their rewards."""
    chosen = _timed(attempts).join(content.select("content_id"), "content_id", "left_semi")
    paid = rewards_per_attempt(rewards).select("attempt_id", F.col("reward_value").alias("paid"))
    return chosen.join(paid, "attempt_id", "left").withColumn(
        "reward_value", F.coalesce(F.col("paid"), F.lit(0))
    )


def _efficiency(rows: DataFrame, outcomes: Outcomes) -> DataFrame:
    def when_cleared(value: Column | str) -> Column:
        value = F.col(value) if isinstance(value, str) else value
        return F.when(F.col("result") == outcomes.clear, value)

    counts = {o: f"{o}_count" for o in _OUTCOMES}
    grouped = rows.groupBy("content_id").agg(
        F.count("*").alias("attempt_count"),
        F.count_distinct("character_id").alias("character_count"),
        *outcome_counts(counts, outcomes),
        rounded(mean_of(when_cleared("clear_time_sec"))).alias("avg_clear_time_sec"),
        rounded(mean_of("duration_sec")).alias("avg_duration_sec"),
        rounded(mean_of(when_cleared("reward_value"))).alias("avg_reward_value_per_clear"),
        rounded(mean_of("reward_value")).alias("avg_reward_value"),
        rounded(F.avg(when_cleared(per_minute("reward_value", "clear_time_sec")))).alias(
            "clear_reward_value_per_minute"
        ),
        rounded(F.avg(per_minute("reward_value", "duration_sec"))).alias("reward_value_per_minute"),
    )
    return grouped.withColumns({f"{o}_rate_pct": rate_pct(c, "attempt_count") for o, c in counts.items()})


def reward_by_tier(
    attempts: DataFrame,
    rewards: DataFrame,
    content: DataFrame,
    tier: str,
    outcomes: Outcomes = DEFAULT.outcomes,
) -> DataFrame:
    """Reward efficiency of all attempted contents of one difficulty, best paid first.

    Value per minute is the mean of the per-attempt ratios.
    """
    members = content.filter(F.col("difficulty") == tier)
    return (
        _efficiency(_paid_attempts(attempts, rewards, members), outcomes)
        .join(members.select("content_id", "content_name", "content_type", "difficulty"), "content_id")
        .select(
            "content_id",
            "content_name",
            "content_type",
            "difficulty",
            "attempt_count",
            "character_count",
            *(f"{o}_rate_pct" for o in _OUTCOMES),
            "avg_clear_time_sec",
            "avg_duration_sec",
            "avg_reward_value_per_clear",
            "avg_reward_value",
            "clear_reward_value_per_minute",
            "reward_value_per_minute",
        )
        .orderBy(F.col("reward_value_per_minute").desc(), "content_id")
    )


def reward_by_line(
    attempts: DataFrame,
    rewards: DataFrame,
    content: DataFrame,
    line: str | Sequence[int],
    outcomes: Outcomes = DEFAULT.outcomes,
) -> DataFrame:
    """Reward efficiency across the tiers of one content line, given by name or by ids."""
    if isinstance(line, str):
        members = content.filter(line_name("content_name") == line)
    else:
        members = content.filter(F.col("content_id").isin(list(line)))
    attributes = (
        "content_id",
        "content_name",
        "difficulty",
        "recommended_combat_power",
        "expected_clear_time_sec",
    )
    return (
        _efficiency(_paid_attempts(attempts, rewards, members), outcomes)
        .join(members.select(*attributes), "content_id")
        .orderBy(difficulty_order("difficulty"), "content_id")
        .select(
            *attributes,
            "attempt_count",
            "character_count",
            *(f"{o}_rate_pct" for o in _OUTCOMES[:3]),
            "avg_clear_time_sec",
            "avg_reward_value_per_clear",
            "clear_reward_value_per_minute",
            "avg_reward_value",
        )
    )
