"""Difficulty factors: fail rate against peers, deaths and clear time against goals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playgauge.config import DEFAULT, Settings
from playgauge.functions.classify import first_match
from playgauge.functions.counting import outcome_counts
from playgauge.functions.exact import mean_of, pct_gap, percent, rounded
from playgauge.operators.selection import ContentIds, restrict
from playgauge.operators.targets import targets_asof


def difficulty_factors(
    attempts: DataFrame,
    content: DataFrame,
    goals: DataFrame,
    ids: ContentIds | None = None,
    settings: Settings = DEFAULT,
) -> DataFrame:
    """Three 0/1 flags per content, their sum and a verdict.

    Peer means cover all contents of the same difficulty and average unrounded
    figures; ``ids`` only limits which contents are reported.
    """
    limits, outcomes = settings.difficulty, settings.outcomes
    cleared = F.col("result") == outcomes.clear
    facts = attempts.groupBy("content_id").agg(
        F.count("*").alias("total_attempt_count"),
        *outcome_counts({o: f"{o}_count" for o in ("clear", "fail", "give_up", "disconnect")}, outcomes),
        mean_of("death_count").alias("_deaths"),
        mean_of(F.when(cleared, F.col("clear_time_sec"))).alias("_clear_time"),
    )
    targets = targets_asof(goals, keys=["content_id"]).select(
        "content_id", "target_clear_rate", "target_death_count_avg", "target_avg_clear_time_sec"
    )
    same_difficulty = Window.partitionBy("difficulty")
    actual = (
        facts.join(content, "content_id")
        .join(targets, "content_id")
        .withColumns(
            {
                "_clear": percent("clear_count", "total_attempt_count"),
                "_fail": percent("fail_count", "total_attempt_count"),
            }
        )
        .withColumn("_peer_fail", F.avg("_fail").over(same_difficulty))
    )
    judged = restrict(actual, ids).withColumns(
        {
            "_fail_gap": F.col("_fail") - F.col("_peer_fail"),
            "_death_gap": pct_gap("_deaths", "target_death_count_avg"),
            "_time_gap": pct_gap("_clear_time", "target_avg_clear_time_sec"),
        }
    )

    def flag(gap: str, limit):
        return F.when(F.col(gap) >= F.lit(limit), 1).otherwise(0)

    flagged = judged.withColumns(
        {
            "fail_rate_flag": flag("_fail_gap", limits.fail_rate_gap_pp),
            "death_count_flag": flag("_death_gap", limits.death_gap_pct),
            "clear_time_flag": flag("_time_gap", limits.clear_time_gap_pct),
        }
    ).withColumn("difficulty_flag_sum", F.col("fail_rate_flag") + F.col("death_count_flag") + F.col("clear_time_flag"))
    verdict = first_match(
        [
            (F.col("difficulty_flag_sum") >= limits.likely_from, "DIFFICULTY_LIKELY"),
            (F.col("difficulty_flag_sum") >= 1, "DIFFICULTY_POSSIBLE"),
        ],
        "DIFFICULTY_UNLIKELY",
    )
    return flagged.select(
        "content_id",
        "content_name",
        "difficulty",
        "content_type",
        "recommended_combat_power",
        "total_attempt_count",
        "clear_count",
        "fail_count",
        "give_up_count",
        "disconnect_count",
        "target_clear_rate",
        rounded("_clear").alias("clear_rate_pct"),
        rounded(F.col("_clear") - F.col("target_clear_rate")).alias("clear_rate_gap_pp"),
        rounded("_fail").alias("fail_rate_pct"),
        rounded("_peer_fail").alias("difficulty_avg_fail_rate_pct"),
        rounded("_fail_gap").alias("fail_rate_gap_pp"),
        "target_death_count_avg",
        rounded("_deaths").alias("avg_death_count"),
        rounded("_death_gap").alias("death_count_gap_pct"),
        "target_avg_clear_time_sec",
        rounded("_clear_time").alias("avg_clear_time_sec"),
        rounded("_time_gap").alias("clear_time_gap_pct"),
        "fail_rate_flag",
        "death_count_flag",
        "clear_time_flag",
        "difficulty_flag_sum",
        verdict.alias("difficulty_verdict"),
    ).orderBy(F.col("difficulty_flag_sum").desc(), "clear_rate_gap_pp", "content_id")
