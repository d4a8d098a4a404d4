"""Population, activity and attempt profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playgauge.config import DEFAULT, Outcomes
from playgauge.functions.counting import outcome_counts, with_distinct_counts
from playgauge.functions.exact import mean, mean_of, rate_pct, rounded
from playgauge.sources.schemas import TABLES


def row_counts(tables: Mapping[str, DataFrame], sort: bool = False) -> DataFrame:
    counts = reduce(
        DataFrame.unionByName,
        [
            df.agg(F.lit(name).alias("table_name"), F.count("*").alias("row_count"))
            for name, df in tables.items()
        ],
    )
    return counts.orderBy(F.col("row_count").desc(), "table_name") if sort else counts


def date_spans(sources: Sequence[tuple[str, DataFrame, str]]) -> DataFrame:
    """First day, last day, inclusive span and rows of each (label, frame, column)."""

    def one(label: str, df: DataFrame, column: str) -> DataFrame:
        bounds = df.agg(
            F.min(column).cast("date").alias("min_date"),
            F.max(column).cast("date").alias("max_date"),
            F.count("*").alias("row_count"),
        )
        return bounds.select(
            F.lit(label).alias("date_source"),
            "min_date",
            "max_date",
            (F.datediff("max_date", "min_date") + 1).alias("date_span_days"),
            "row_count",
        )

    return reduce(DataFrame.unionByName, [one(*source) for source in sources])


def standard_date_sources(tables: Mapping[str, DataFrame]) -> list[tuple[str, DataFrame, str]]:
    return [
        (f"{t.name}.{t.time_column}", tables[t.name], t.time_column)
        for t in TABLES.values()
        if t.time_column is not None and t.name in tables
    ]


def population_summary(accounts: DataFrame, characters: DataFrame, active_status: str = "active") -> DataFrame:
    """Accounts and their characters by state, with averages over live characters.

    Characters are reduced to one row per account first. Both tables hold a
    key value once, so counts of rows and sums replace the distinct counts.
    """
    live, deleted = F.col("is_deleted") == 0, F.col("is_deleted") == 1
    measures = ("level", "combat_power", "gear_score")
    per_account = characters.groupBy("account_id").agg(
        F.count("character_id").alias("n_all"),
        F.count_if(live).alias("n_live"),
        F.count_if(deleted).alias("n_deleted"),
        *(F.sum(F.when(live, F.col(m))).alias(f"{m}_sum") for m in measures),
        *(F.count(F.when(live, F.col(m))).alias(f"{m}_n") for m in measures),
    )
    status, tester = F.col("account_status"), F.col("is_tester")
    totals = accounts.join(per_account, "account_id", "left").agg(
        F.count("account_id").alias("total_account_count"),
        F.count_if(status == active_status).alias("active_account_count"),
        F.count_if(status != active_status).alias("non_active_account_count"),
        F.count_if(tester == 1).alias("tester_account_count"),
        F.count_if(tester == 0).alias("normal_account_count"),
        *(
            F.coalesce(F.sum(n), F.lit(0)).alias(alias)
            for n, alias in (
                ("n_all", "total_character_count"),
                ("n_live", "active_character_count"),
                ("n_deleted", "deleted_character_count"),
            )
        ),
        *(
            rounded(mean(F.sum(f"{m}_sum"), F.sum(f"{m}_n"))).alias(f"avg_active_character_{m}")
            for m in measures
        ),
    )
    per = rounded(mean("total_character_count", "total_account_count"))
    ordered = [c for c in totals.columns if not c.startswith("avg_")]
    averages = [c for c in totals.columns if c.startswith("avg_")]
    return totals.select(*ordered, per.alias("avg_character_count_per_account"), *averages)


def daily_kpis(activity: DataFrame, max_error: float | None = None) -> DataFrame:
    """One row per activity day; ``max_error`` allows estimated user counts."""
    summed = {
        "login_count": "total_login_count",
        "session_count": "total_session_count",
        "play_minutes": "total_play_minutes",
        "combat_minutes": "total_combat_minutes",
        "non_combat_minutes": "total_non_combat_minutes",
        "content_attempt_count": "total_content_attempt_count",
        "boss_attempt_count": "total_boss_attempt_count",
        "enhancement_attempt_count": "total_enhancement_attempt_count",
        "payment_count": "total_payment_count",
        "earned_gold": "total_earned_gold",
        "spent_gold": "total_spent_gold",
    }
    sums = activity.groupBy("activity_date").agg(*(F.sum(c).alias(a) for c, a in summed.items()))
    days = with_distinct_counts(
        sums,
        activity,
        ["activity_date"],
        {"dau": "account_id", "active_character_count": "character_id"},
        max_error,
    )
    totals = list(summed.values())
    return days.select(
        "activity_date",
        "dau",
        "active_character_count",
        *totals[:3],
        rounded(mean("total_play_minutes", "dau")).alias("avg_play_minutes_per_account"),
        *totals[3:],
    ).orderBy("activity_date")


_PARTICIPANTS = {
    "participant_account_count": "account_id",
    "participant_character_count": "character_id",
}
_EFFORT = ("death_count", "revive_count", "potion_used_count")


def daily_result_distribution(attempts: DataFrame) -> DataFrame:
    """Attempts per day and result; clear time averages every recorded value."""
    keyed = attempts.withColumns(
        {"attempt_date": F.to_date("attempt_started_at"), "attempt_result": F.col("result")}
    )
    keys = ["attempt_date", "attempt_result"]
    averages = [
        rounded(mean_of(c)).alias(f"avg_{c}") for c in ("clear_time_sec", *_EFFORT)
    ]
    grouped = keyed.groupBy(*keys).agg(F.count("*").alias("attempt_count"), *averages)
    return (
        with_distinct_counts(grouped, keyed, keys, _PARTICIPANTS)
        .select(
            *keys,
            "attempt_count",
            *_PARTICIPANTS,
            *(f"avg_{c}" for c in ("clear_time_sec", *_EFFORT)),
        )
        .orderBy(*keys)
    )


def overall_summary(attempts: DataFrame, outcomes: Outcomes = DEFAULT.outcomes) -> DataFrame:
    """One row over the whole period; clear time averages clears only."""
    cleared = F.col("result") == outcomes.clear
    total = attempts.agg(
        F.min("attempt_started_at").cast("date").alias("min_attempt_date"),
        F.max("attempt_started_at").cast("date").alias("max_attempt_date"),
        F.count("*").alias("total_attempt_count"),
        *outcome_counts({"clear": "clear_attempt_count", "fail": "fail_attempt_count"}, outcomes),
        rounded(mean_of(F.when(cleared, F.col("clear_time_sec")))).alias("avg_clear_time_sec"),
        *(rounded(mean_of(c)).alias(f"avg_{c}") for c in _EFFORT),
    )
    counted = {"date_count": F.unix_date(F.to_date("attempt_started_at")), **_PARTICIPANTS}
    return with_distinct_counts(total, attempts, [], counted).select(
        "date_count",
        "min_attempt_date",
        "max_attempt_date",
        "total_attempt_count",
        "clear_attempt_count",
        "fail_attempt_count",
        rate_pct("clear_attempt_count", "total_attempt_count").alias("clear_rate_pct"),
        rate_pct("fail_attempt_count", "total_attempt_count").alias("fail_rate_pct"),
        *_PARTICIPANTS,
        "avg_clear_time_sec",
        *(f"avg_{c}" for c in _EFFORT),
    )


def result_share(attempts: DataFrame) -> DataFrame:
    """Attempts per result and their share of all attempts.

    The total is a window over the grouped rows, one per result code.
    """
    per_result = attempts.groupBy(F.col("result").alias("attempt_result")).agg(
        F.count("*").alias("attempt_count")
    )
    everything = F.sum("attempt_count").over(Window.partitionBy())
    return per_result.withColumn("attempt_rate_pct", rate_pct("attempt_count", everything)).orderBy(
        F.col("attempt_count").desc(), "attempt_result"
    )
