"""Goal-gap analysis: what each content reached in a window against its goals."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playgauge.config import DEFAULT, Settings
from playgauge.functions.classify import first_match
from playgauge.functions.counting import outcome_counts, zero_if_missing
from playgauge.functions.exact import mean, mean_of, percent, rounded
from playgauge.functions.period import in_period
from playgauge.operators.eligibility import eligible_by_content
from playgauge.operators.targets import targets_asof

# Most pressing first; the order of the result.
STATUSES = (
    "LOW_PARTICIPATION",
    "LOW_CLEAR_RATE",
    "LONG_CLEAR_TIME",
    "HIGH_DEATH_COUNT",
    "NO_DATA",
    "NORMAL",
)
_EFFORT = ("death_count", "revive_count", "potion_used_count", "party_member_count")


def attempt_summary(attempts: DataFrame, start: date, end: date, settings: Settings = DEFAULT) -> DataFrame:
    """Per content in the window: attempts, participants, repeat participants, averages.

    One row per content and character comes first, with sums instead of
    averages. It turns both distinct counts into row counts and serves the
    repeat count as well, all from one scan.
    """
    outcomes = settings.outcomes
    cleared = F.col("result") == outcomes.clear
    clear_time = F.when(cleared, F.col("clear_time_sec"))
    per_character = (
        in_period(attempts, "attempt_started_at", F.lit(start), F.lit(end))
        .groupBy("content_id", "character_id")
        .agg(
            F.count("*").alias("n"),
            *outcome_counts({"clear": "clear_count", "fail": "fail_count"}, outcomes),
            F.sum(clear_time).alias("clear_time_sec_sum"),
            F.count(clear_time).alias("clear_time_sec_n"),
            *(F.sum(c).alias(f"{c}_sum") for c in _EFFORT),
            *(F.count(c).alias(f"{c}_n") for c in _EFFORT),
            F.count_if(F.col("reward_claimed") == 1).alias("reward_claimed_count"),
        )
    )
    repeated = (F.col("n") >= settings.gap.min_retry_attempts) & F.col("character_id").isNotNull()
    return per_character.groupBy("content_id").agg(
        F.sum("n").alias("total_attempt_count"),
        F.count("character_id").alias("participant_character_count"),
        F.count_if(repeated).alias("retry_character_count"),
        *(F.sum(c).alias(c) for c in ("clear_count", "fail_count", "reward_claimed_count")),
        *(
            mean(F.sum(f"{c}_sum"), F.sum(f"{c}_n")).alias(f"avg_{c}")
            for c in ("clear_time_sec", *_EFFORT)
        ),
    )


def retry_summary(attempts: DataFrame, start: date, end: date, settings: Settings = DEFAULT) -> DataFrame:
    """Repeat participants per content in the window."""
    return attempt_summary(attempts, start, end, settings).select("content_id", "retry_character_count")


def reward_summary(rewards: DataFrame, start: date, end: date) -> DataFrame:
    """Reward rows and values per content in the window."""
    value = "estimated_gold_value"
    return (
        in_period(rewards, "rewarded_at", F.lit(start), F.lit(end))
        .groupBy("content_id")
        .agg(
            F.count("*").alias("reward_log_count"),
            mean_of(value).alias("avg_reward_value"),
            F.sum(value).alias("total_reward_value"),
        )
    )


def health_gap(
    attempts: DataFrame,
    activity: DataFrame,
    characters: DataFrame,
    content: DataFrame,
    goals: DataFrame,
    rewards: DataFrame,
    start: date,
    end: date,
    settings: Settings = DEFAULT,
    target_mode: str = "latest",
) -> DataFrame:
    """Rates, gaps to the goals and a status for every active content."""
    base = gap_base(attempts, activity, characters, content, goals, rewards, start, end, settings, target_mode)
    return assess_gaps(base, settings)


def gap_base(
    attempts: DataFrame,
    activity: DataFrame,
    characters: DataFrame,
    content: DataFrame,
    goals: DataFrame,
    rewards: DataFrame,
    start: date,
    end: date,
    settings: Settings = DEFAULT,
    target_mode: str = "latest",
) -> DataFrame:
    """Active contents with what they reached in the window and their goals."""
    eligible = eligible_by_content(activity, characters, content, start, end)
    tried = attempt_summary(attempts, start, end, settings)
    paid = reward_summary(rewards, start, end).select("content_id", "avg_reward_value")
    targets = targets_asof(goals, as_of=end, mode=target_mode)
    return (
        content.filter(F.col("is_active") == 1)
        .join(eligible, "content_id", "left")
        .join(tried, "content_id", "left")
        .join(paid, "content_id", "left")
        .join(targets, ["content_id", "difficulty"], "left")
    )


def assess_gaps(base: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Rates, gaps and status; a content without attempts has a NULL attempt count in ``base``."""
    no_data = F.col("total_attempt_count").isNull()
    base = base.withColumn("_no_data", no_data).withColumns(
        zero_if_missing(
            "eligible_character_count",
            "recommended_ready_character_count",
            "total_attempt_count",
            "participant_character_count",
            "retry_character_count",
            "clear_count",
            "fail_count",
            "reward_claimed_count",
        )
    )
    # Unrounded rates; the gaps and the status are taken from these.
    base = base.withColumns(
        {
            "_participation": percent("participant_character_count", "eligible_character_count"),
            "_clear": percent("clear_count", "total_attempt_count"),
        }
    )
    limits = settings.gap
    status = first_match(
        [
            (F.col("_no_data"), "NO_DATA"),
            (
                F.col("_participation") < F.col("target_participation_rate") * F.lit(limits.participation_share),
                "LOW_PARTICIPATION",
            ),
            (F.col("_clear") < F.col("target_clear_rate") - F.lit(limits.clear_rate_drop_pp), "LOW_CLEAR_RATE"),
            (
                F.col("avg_clear_time_sec") > F.col("target_avg_clear_time_sec") * F.lit(limits.clear_time_factor),
                "LONG_CLEAR_TIME",
            ),
            (
                F.col("avg_death_count") > F.col("target_death_count_avg") * F.lit(limits.death_factor),
                "HIGH_DEATH_COUNT",
            ),
        ],
        "NORMAL",
    )
    severity = first_match([(F.col("health_status") == s, i) for i, s in enumerate(STATUSES)], len(STATUSES))
    return base.select(
        "content_id",
        "content_name",
        "content_type",
        "difficulty",
        "required_level",
        "recommended_combat_power",
        "eligible_character_count",
        "recommended_ready_character_count",
        "total_attempt_count",
        "participant_character_count",
        rounded("_participation").alias("participation_rate"),
        rounded(percent("recommended_ready_character_count", "eligible_character_count")).alias(
            "recommended_ready_rate"
        ),
        rounded("_clear").alias("clear_rate"),
        rounded(percent("fail_count", "total_attempt_count")).alias("fail_rate"),
        rounded(percent("retry_character_count", "participant_character_count")).alias("retry_rate"),
        *(rounded(f"avg_{c}").alias(f"avg_{c}") for c in ("clear_time_sec", *_EFFORT)),
        rounded(percent("reward_claimed_count", "clear_count")).alias("reward_claim_rate"),
        rounded("avg_reward_value").alias("avg_reward_value"),
        "target_participation_rate",
        "target_clear_rate",
        "target_avg_clear_time_sec",
        "target_retry_rate",
        "target_death_count_avg",
        "target_reward_value",
        rounded(F.col("_participation") - F.col("target_participation_rate")).alias("participation_gap"),
        rounded(F.col("_clear") - F.col("target_clear_rate")).alias("clear_rate_gap"),
        rounded(F.col("avg_clear_time_sec") - F.col("target_avg_clear_time_sec")).alias("clear_time_gap"),
        rounded(F.col("avg_death_count") - F.col("target_death_count_avg")).alias("death_count_gap"),
        status.alias("health_status"),
    ).orderBy(severity, "participation_gap", "clear_rate_gap", "content_id")
