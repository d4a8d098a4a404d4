"""Outcomes by power band."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playgauge.config import DEFAULT, Settings
from playgauge.functions.classify import power_band
from playgauge.functions.counting import outcome_counts
from playgauge.functions.exact import mean, percent, rate_pct, rounded
from playgauge.operators.selection import ContentIds, restrict
from playgauge.operators.targets import targets_asof

_OUTCOMES = ("clear", "fail", "give_up", "disconnect")


def power_segments(
    attempts: DataFrame,
    characters: DataFrame,
    content: DataFrame,
    goals: DataFrame,
    ids: ContentIds | None = None,
    settings: Settings = DEFAULT,
    target_mode: str = "latest",
    party_suffix: str = "인",
) -> DataFrame:
    """Content by party size by power band, only segments below the target clear rate.

    Attempts shrink to one row per content, party size and character before the
    characters join. A character has one band per content, so distinct
    characters are counted as rows.
    """
    outcomes = settings.outcomes
    per_character = (
        restrict(attempts, ids)
        .groupBy("content_id", "party_member_count", "character_id")
        .agg(F.count("*").alias("n"), *outcome_counts({"clear": "clears", "fail": "fails"}, outcomes))
    )
    known = content.select("content_id", "content_name", "difficulty", "recommended_combat_power")
    segments = (
        per_character.join(known.select("content_id", "recommended_combat_power"), "content_id")
        .join(characters.select("character_id", "combat_power"), "character_id")
        .withColumn("power_band", power_band("combat_power", "recommended_combat_power", settings.bands))
        .groupBy("content_id", "party_member_count", "power_band")
        .agg(
            F.sum("n").alias("attempt_count"),
            F.count("*").alias("character_count"),
            F.sum("clears").alias("clear_count"),
            F.sum("fails").alias("fail_count"),
        )
    )
    targets = targets_asof(goals, mode=target_mode).select("content_id", "difficulty", "target_clear_rate")
    band_order = F.array_position(F.array(*map(F.lit, settings.bands.labels)), F.col("power_band"))
    return (
        segments.join(known, "content_id")
        .join(targets, ["content_id", "difficulty"])
        .withColumns(
            {
                "clear_rate_pct": rate_pct("clear_count", "attempt_count"),
                "fail_rate_pct": rate_pct("fail_count", "attempt_count"),
            }
        )
        .filter(F.col("clear_rate_pct") < F.col("target_clear_rate"))
        .orderBy("content_id", "party_member_count", band_order, "target_clear_rate")
        .select(
            "content_id",
            "content_name",
            "difficulty",
            F.concat(F.col("party_member_count").cast("string"), F.lit(party_suffix)).alias("party_size"),
            "power_band",
            "recommended_combat_power",
            "attempt_count",
            "character_count",
            "clear_count",
            "clear_rate_pct",
            "target_clear_rate",
            rounded(F.col("clear_rate_pct") - F.col("target_clear_rate")).alias("clear_rate_gap_pp"),
            "fail_count",
            "fail_rate_pct",
            F.lit("BELOW_TARGET").alias("target_status"),
        )
    )


def band_performance(
    attempts: DataFrame,
    characters: DataFrame,
    content: DataFrame,
    goals: DataFrame,
    content_id: int,
    settings: Settings = DEFAULT,
) -> DataFrame:
    """Outcomes, deaths and clear times of one content by power band, against its goals."""
    outcomes = settings.outcomes
    clear_time = F.when(F.col("result") == outcomes.clear, F.col("clear_time_sec"))
    per_character = (
        attempts.filter(F.col("content_id") == content_id)
        .groupBy("content_id", "character_id")
        .agg(
            F.count("*").alias("n"),
            *outcome_counts({o: f"{o}_count" for o in _OUTCOMES}, outcomes),
            F.sum("death_count").alias("deaths"),
            F.count("death_count").alias("deaths_n"),
            F.sum(clear_time).alias("clear_time"),
            F.count(clear_time).alias("clear_time_n"),
        )
    )
    one = content.filter(F.col("content_id") == content_id).select(
        "content_id", "difficulty", "recommended_combat_power"
    )
    power = F.col("combat_power").cast("decimal(20,4)")
    bands = (
        per_character.join(one, "content_id")
        .join(characters.select("character_id", "combat_power"), "character_id")
        .withColumn("power_band", power_band("combat_power", "recommended_combat_power", settings.bands))
        .groupBy("content_id", "difficulty", "recommended_combat_power", "power_band")
        .agg(
            F.sum("n").alias("attempt_count"),
            F.count("*").alias("character_count"),
            mean(
                F.sum((power * F.col("n")).cast("decimal(28,4)")), F.sum(F.when(power.isNotNull(), F.col("n")))
            ).alias("_power"),
            *(F.sum(f"{o}_count").alias(f"{o}_count") for o in _OUTCOMES),
            mean(F.sum("deaths"), F.sum("deaths_n")).alias("_deaths"),
            mean(F.sum("clear_time"), F.sum("clear_time_n")).alias("_clear_time"),
        )
    )
    targets = targets_asof(goals, mode="latest_ties").select(
        "content_id", "difficulty", "target_clear_rate", "target_death_count_avg", "target_avg_clear_time_sec"
    )
    recommended = F.nullif(F.col("recommended_combat_power").cast("decimal(18,0)"), F.lit(0))
    return (
        bands.join(targets, ["content_id", "difficulty"], "left")
        .select(
            "power_band",
            "attempt_count",
            "character_count",
            rounded("_power", 0).alias("avg_combat_power"),
            rounded(F.col("_power").cast("decimal(24,10)") * 100 / recommended).alias("avg_power_ratio_pct"),
            "target_clear_rate",
            *(rate_pct(f"{o}_count", "attempt_count").alias(f"{o}_rate_pct") for o in _OUTCOMES),
            rounded(percent("clear_count", "attempt_count") - F.col("target_clear_rate")).alias("clear_rate_gap_pp"),
            rounded("_deaths").alias("avg_death_count"),
            "target_death_count_avg",
            rounded(F.col("_deaths") - F.col("target_death_count_avg")).alias("death_count_gap"),
            rounded("_clear_time").alias("avg_clear_time_sec"),
            "target_avg_clear_time_sec",
            rounded(F.col("_clear_time") - F.col("target_avg_clear_time_sec")).alias("clear_time_gap_sec"),
        )
        .orderBy("power_band")
    )
