"""Release maturity of one content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playgauge.config import DEFAULT, Settings
from playgauge.functions.classify import first_match
from playgauge.functions.exact import percent, rounded
from playgauge.operators.targets import targets_asof


def release_maturity(
    attempts: DataFrame,
    content: DataFrame,
    goals: DataFrame,
    content_id: int,
    settings: Settings = DEFAULT,
) -> DataFrame:
    """Days between release and the last attempt, the clear-rate gap, and the stage."""
    facts = (
        attempts.filter(F.col("content_id") == content_id)
        .groupBy("content_id")
        .agg(
            F.min("attempt_started_at").cast("date").alias("first_attempt_date"),
            F.max("attempt_started_at").cast("date").alias("reference_date"),
            F.count("*").alias("attempt_count"),
            F.count_distinct("character_id").alias("character_count"),
            F.count_if(F.col("result") == settings.outcomes.clear).alias("clears"),
        )
    )
    targets = targets_asof(goals, mode="latest_ties").select("content_id", "difficulty", "target_clear_rate")
    clear_rate = percent("clears", "attempt_count")
    age = F.col("days_since_release")
    stage = first_match(
        [
            (age < settings.release.settling_from, "OBSERVE"),
            (age < settings.release.settled_from, "SETTLING"),
        ],
        "SETTLED",
    )
    return (
        facts.join(content, "content_id")
        .join(targets, ["content_id", "difficulty"], "left")
        .withColumn("days_since_release", F.datediff("reference_date", "release_date"))
        .select(
            "content_id",
            "content_name",
            "content_type",
            "difficulty",
            "release_date",
            "first_attempt_date",
            "reference_date",
            "days_since_release",
            "attempt_count",
            "character_count",
            "target_clear_rate",
            rounded(clear_rate).alias("clear_rate_pct"),
            rounded(clear_rate - F.col("target_clear_rate")).alias("clear_rate_gap_pp"),
            stage.alias("release_stage"),
        )
    )
