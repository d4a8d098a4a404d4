"""Choosing the design-goal version that applies."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MODES = ("latest", "latest_ties", "all")


def targets_asof(
    goals: DataFrame,
    keys: Sequence[str] = ("content_id", "difficulty"),
    as_of: date | None = None,
    mode: str = "latest",
) -> DataFrame:
    """Goal rows per key, optionally only versions that began by ``as_of``.

    ``latest``       one row per key: the newest version, ties to the highest goal id
    ``latest_ties``  the newest version with all its ties
    ``all``          every version; joins to it repeat a content per version
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if as_of is not None:
        goals = goals.filter(F.col("valid_from") <= F.lit(as_of))
    if mode == "all":
        return goals
    if mode == "latest_ties":
        newest_first = Window.partitionBy(*keys).orderBy(F.col("valid_from").desc())
        return goals.withColumn("_rank", F.rank().over(newest_first)).filter("_rank = 1").drop("_rank")
    # max_by is combined on the map side, so a key with very many versions
    # sends one row per task.
    rest = [c for c in goals.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct("valid_from", "goal_id"))
    return goals.groupBy(*keys).agg(newest.alias("_row")).select(*keys, "_row.*")


def target_lookup(content: DataFrame, goals: DataFrame, ids: Sequence[int]) -> DataFrame:
    """Goal versions mapped to the chosen contents."""
    chosen = content.filter(F.col("content_id").isin(list(ids)))
    return (
        chosen.join(goals, ["content_id", "difficulty"], "left")
        .select(
            "content_id",
            "content_name",
            "difficulty",
            "target_participation_rate",
            "target_clear_rate",
            "target_avg_clear_time_sec",
            "target_death_count_avg",
            "valid_from",
            "valid_to",
        )
        .orderBy("content_id", "valid_from")
    )
