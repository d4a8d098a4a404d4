"""Content health: outcome rates and effort per content, and views on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playgauge.config import DEFAULT, Outcomes
from playgauge.functions.counting import outcome_counts, with_distinct_counts
from playgauge.functions.exact import mean_of, rate_pct, rounded

_COUNTS = {
    "clear": "clear_attempt_count",
    "fail": "fail_attempt_count",
    "give_up": "give_up_attempt_count",
    "disconnect": "disconnect_attempt_count",
}
_PARTICIPANTS = {
    "participant_account_count": "account_id",
    "participant_character_count": "character_id",
}
_ATTRIBUTES = (
    "content_id",
    "content_name",
    "content_type",
    "difficulty",
    "required_level",
    "recommended_combat_power",
    "min_party_size",
    "max_party_size",
    "expected_clear_time_sec",
)
_EFFORT = ("death_count", "revive_count", "potion_used_count", "party_member_count")


def content_health(
    attempts: DataFrame,
    content: DataFrame,
    outcomes: Outcomes = DEFAULT.outcomes,
    max_error: float | None = None,
) -> DataFrame:
    """Attempts, participants, outcomes and averages of every attempted content.

    Facts are grouped by content id alone; the descriptive columns join the
    result, one row per content. ``max_error`` allows estimated participants.
    """
    cleared = F.col("result") == outcomes.clear
    facts = attempts.groupBy("content_id").agg(
        F.count("*").alias("total_attempt_count"),
        *outcome_counts(_COUNTS, outcomes),
        rounded(mean_of(F.when(cleared, F.col("clear_time_sec")))).alias("avg_clear_time_sec"),
        *(rounded(mean_of(c)).alias(f"avg_{c}") for c in _EFFORT),
        F.count_if(F.col("reward_claimed") == 1).alias("reward_claimed_count"),
    )
    facts = with_distinct_counts(facts, attempts, ["content_id"], _PARTICIPANTS, max_error)
    rates = [
        rate_pct(count, "total_attempt_count").alias(f"{outcome}_rate_pct")
        for outcome, count in _COUNTS.items()
    ]
    return (
        facts.join(content.select(*_ATTRIBUTES), "content_id")
        .select(
            *_ATTRIBUTES,
            "total_attempt_count",
            *_PARTICIPANTS,
            *_COUNTS.values(),
            *rates,
            "avg_clear_time_sec",
            *(f"avg_{c}" for c in _EFFORT),
            "reward_claimed_count",
            rate_pct("reward_claimed_count", "total_attempt_count").alias("reward_claimed_rate_pct"),
        )
        .orderBy(F.col("total_attempt_count").desc(), "content_id")
    )


def health_rollup(health: DataFrame) -> DataFrame:
    """Spread of the per-content figures; averages are taken over the rounded rates."""

    def avg(column: str):
        return rounded(mean_of(column))

    total = "total_attempt_count"
    spread = []
    for outcome in _COUNTS:
        rate = f"{outcome}_rate_pct"
        spread.append(avg(rate).alias(f"avg_{rate}"))
        if outcome == "clear":
            spread.append(F.min(rate).alias(f"min_{rate}"))
        spread.append(F.max(rate).alias(f"max_{rate}"))
    return health.agg(
        F.count("*").alias("content_count"),
        F.sum(total).alias(total),
        avg(total).alias("avg_attempt_count_per_content"),
        F.min(total).alias("min_attempt_count"),
        F.max(total).alias("max_attempt_count"),
        *(avg(c).alias(f"avg_{c}") for c in _PARTICIPANTS),
        *spread,
        *(avg(f"avg_{c}").alias(f"avg_{c}") for c in ("clear_time_sec", *_EFFORT[:3])),
        avg("reward_claimed_rate_pct").alias("avg_reward_claimed_rate_pct"),
    )


def worst_contents(health: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` contents with the lowest clear rate, then most fails, then most give-ups."""
    return (
        health.select(
            *_ATTRIBUTES[:4],
            "total_attempt_count",
            "participant_account_count",
            *(f"{outcome}_rate_pct" for outcome in _COUNTS),
            "avg_clear_time_sec",
            "avg_death_count",
            "avg_potion_used_count",
            "reward_claimed_rate_pct",
        )
        .orderBy(
            F.col("clear_rate_pct").asc(),
            F.col("fail_rate_pct").desc(),
            F.col("give_up_rate_pct").desc(),
            "content_id",
        )
        .limit(k)
    )
