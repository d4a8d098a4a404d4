"""Participation of the characters that could take part."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playgauge.config import DEFAULT, Settings
from playgauge.functions.classify import first_match
from playgauge.functions.counting import outcome_counts, zero_if_missing
from playgauge.functions.exact import mean, percent, rounded
from playgauge.operators.eligibility import eligible_characters, live_characters
from playgauge.operators.selection import ContentIds, restrict

_OUTCOMES = ("clear", "fail", "give_up", "disconnect")
_CHALLENGERS = (
    "actual_attempt_character_count",
    "actual_attempt_character_count_100",
    "actual_attempt_character_count_80",
    "actual_attempt_character_count_under_80",
)


def challengers(attempts: DataFrame, content: DataFrame, characters: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Attempts and distinct live challengers per content, by power readiness.

    Attempts shrink to one row per content and character before they meet the
    characters, so the join moves no repeat attempts, a very active character
    brings at most one row per content, and distinct counts become row counts.
    """
    counts = [f"{o}_count" for o in _OUTCOMES]
    per_character = attempts.groupBy("content_id", "character_id").agg(
        F.count("*").alias("n"),
        *outcome_counts({o: f"{o}_count" for o in _OUTCOMES}, settings.outcomes),
    )
    ready = F.col("recommended_combat_power")
    near_ready = ready * F.lit(settings.participation.near_ready_share)
    level, needed, power = F.col("level"), F.col("required_level"), F.col("combat_power")
    return (
        per_character.join(content.select("content_id", "required_level", "recommended_combat_power"), "content_id")
        .join(live_characters(characters).select("character_id", "level", "combat_power"), "character_id")
        .groupBy("content_id")
        .agg(
            F.sum("n").alias("total_attempt_count"),
            F.count("*").alias(_CHALLENGERS[0]),
            F.count_if((level >= needed) & (power >= ready)).alias(_CHALLENGERS[1]),
            F.count_if((level >= needed) & (power >= near_ready)).alias(_CHALLENGERS[2]),
            F.count_if((level < needed) | (power < near_ready)).alias(_CHALLENGERS[3]),
            *(F.sum(c).alias(c) for c in counts),
        )
    )


def eligible_participation(
    attempts: DataFrame,
    content: DataFrame,
    characters: DataFrame,
    ids: ContentIds | None = None,
    settings: Settings = DEFAULT,
) -> DataFrame:
    """Challengers against eligible characters, against contents of the same difficulty.

    Peer means cover all active contents; ``ids`` only limits the report.
    """
    limits = settings.participation
    attributes = (
        "content_id",
        "content_name",
        "content_type",
        "difficulty",
        "required_level",
        "recommended_combat_power",
    )
    eligible = eligible_characters(content, characters, limits.near_ready_share)
    tried = challengers(attempts, content, characters, settings)
    metrics = (
        content.filter(F.col("is_active") == 1)
        .select(*attributes)
        .join(eligible, "content_id", "left")
        .join(tried, "content_id", "left")
        .withColumns(
            zero_if_missing("total_attempt_count", *_CHALLENGERS, *(f"{o}_count" for o in _OUTCOMES))
        )
        .withColumns(
            {
                "_rate_100": percent(_CHALLENGERS[1], "eligible_character_count_100"),
                "_rate_80": percent(_CHALLENGERS[2], "eligible_character_count_80"),
                "_under_80": percent(_CHALLENGERS[3], _CHALLENGERS[0]),
                "_repeat": mean("total_attempt_count", _CHALLENGERS[0]),
                **{f"_{o}": percent(f"{o}_count", "total_attempt_count") for o in _OUTCOMES},
            }
        )
    )
    same_difficulty = Window.partitionBy("difficulty")
    compared = metrics.withColumns(
        {
            **{f"_peer{c}": F.avg(c).over(same_difficulty) for c in ("_rate_100", "_rate_80", "_repeat")},
            "_peer_attempts": mean(
                F.sum("total_attempt_count").over(same_difficulty), F.count("*").over(same_difficulty)
            ),
        }
    )
    rate, peer_rate = F.col("_rate_80"), F.col("_peer_rate_80")
    repeat, peer_repeat = F.col("_repeat"), F.col("_peer_repeat")
    verdict = first_match(
        [
            ((rate < peer_rate) & (repeat < peer_repeat), "LOW_ENTRY_LOW_REPEAT"),
            ((rate < peer_rate) & (repeat >= peer_repeat), "LOW_ENTRY_BUT_REPEATING"),
            ((rate >= peer_rate) & (F.col("_fail") >= F.lit(limits.heavy_fail_rate)), "ENTERED_BUT_FAILING"),
            (F.col("_under_80") >= F.lit(limits.under_power_share_pct), "MANY_UNDER_POWERED"),
            (rate >= peer_rate, "HEALTHY"),
        ],
        "CHECK_FURTHER",
    )
    return restrict(compared, ids).select(
        *attributes,
        "eligible_character_count_100",
        "eligible_character_count_80",
        *_CHALLENGERS,
        "total_attempt_count",
        rounded("_rate_100").alias("participation_rate_100_pct"),
        rounded("_rate_80").alias("participation_rate_80_pct"),
        rounded("_under_80").alias("under_80_character_share_pct"),
        rounded("_peer_rate_100").alias("difficulty_avg_participation_rate_100_pct"),
        rounded(F.col("_rate_100") - F.col("_peer_rate_100")).alias("participation_rate_100_gap_pp"),
        rounded("_peer_rate_80").alias("difficulty_avg_participation_rate_80_pct"),
        rounded(rate - peer_rate).alias("participation_rate_80_gap_pp"),
        rounded("_repeat").alias("avg_attempts_per_character"),
        rounded("_peer_repeat").alias("difficulty_avg_attempts_per_character"),
        rounded(repeat - peer_repeat).alias("attempts_per_character_gap"),
        rounded("_peer_attempts", 0).alias("difficulty_avg_attempt_count"),
        rounded(F.col("total_attempt_count") - F.col("_peer_attempts"), 0).alias("attempt_count_gap"),
        *(rounded(f"_{o}").alias(f"{o}_rate_pct") for o in _OUTCOMES),
        verdict.alias("participation_verdict"),
    ).orderBy("participation_rate_80_pct", "content_id")
