"""Registered queries: every operator over the role views of a data folder."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from playgauge.config import DEFAULT
from playgauge.functions.exact import rounded
from playgauge.operators import (
    difficulty,
    eligibility,
    gap,
    health,
    participation,
    patterns,
    profile,
    quality,
    release,
    rewards,
    segments,
    targets,
    usage,
)
from playgauge.plans.roles import Roles
from playgauge.sources import loading
from playgauge.sources.schemas import TABLES

# Arguments of the registered queries; the SQL checks use the same values.
WINDOW_START, WINDOW_END = date(1996, 1, 1), date(1996, 12, 31)
PLAY_MINUTES_CAP = 400
FOCUS_CONTENT = 20
FOCUS_PATTERN = "R"
FOCUS_TIER = "hard"
FOCUS_LINE = "AFRICA"
LOOKUP_IDS = (1, 20, 24)


def plain_types(df: DataFrame) -> DataFrame:
    """Decimals as double, integers as bigint and dates as ISO text, for comparison across engines."""

    def plain(field: T.StructField) -> str:
        if isinstance(field.dataType, T.DecimalType):
            return f"CAST({field.name} AS DOUBLE) AS {field.name}"
        if isinstance(field.dataType, T.IntegralType):
            return f"CAST({field.name} AS BIGINT) AS {field.name}"
        if isinstance(field.dataType, T.DateType):
            return f"CAST({field.name} AS STRING) AS {field.name}"
        return field.name

    return df.selectExpr(*(plain(field) for field in df.schema.fields))


def _dq_fk_orphans(r: Roles) -> DataFrame:
    return quality.orphans(r.source("events"), "user_id", r.source("supplier"), "s_suppkey")


def _dq_fk_summary(r: Roles) -> DataFrame:
    extra = quality.Reference("events", "user_id", "supplier", "s_suppkey")
    return quality.orphan_summary(r, [*quality.STANDARD_REFERENCES, extra])


def _dq_orphan_multi_parent(r: Roles) -> DataFrame:
    return quality.orphans_multi(
        r.daily_activity,
        [
            quality.Parent("account_id", r.accounts, "account_id"),
            quality.Parent("character_id", r.characters, "character_id"),
            quality.Parent("character_id", r.source("supplier"), "s_suppkey"),
        ],
    )


def _dq_null_profile(r: Roles) -> DataFrame:
    parts = [quality.null_profile(r[n], TABLES[n]) for n in ("accounts", "content_attempts", "reward_logs")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _load_quarantine(r: Roles) -> DataFrame:
    table = TABLES["content_attempts"]
    return loading.outcome_counts(loading.judged(loading.parse_lines(r.attempt_lines, table), table), table)


def _usage(r: Roles, mode: str = "latest") -> DataFrame:
    return usage.usage_overview(
        r.content_attempts,
        r.daily_activity,
        r.characters,
        r.content_master,
        r.content_design_goals,
        target_mode=mode,
    )


def _gap(r: Roles, mode: str = "latest") -> DataFrame:
    return gap.health_gap(
        r.content_attempts,
        r.daily_activity,
        r.characters,
        r.content_master,
        r.content_design_goals,
        r.reward_logs,
        WINDOW_START,
        WINDOW_END,
        target_mode=mode,
    )


def _health(r: Roles) -> DataFrame:
    return health.content_health(r.content_attempts, r.content_master)


def _segments(r: Roles, mode: str = "latest") -> DataFrame:
    return segments.power_segments(
        r.content_attempts, r.characters, r.content_master, r.content_design_goals, target_mode=mode
    )


def _below_target(r: Roles) -> DataFrame:
    """Contents whose clear rate misses its target; the reports that follow them up take this frame."""
    return usage.below_target(r.content_attempts, r.content_master, r.content_design_goals)


def _rounded(df: DataFrame) -> DataFrame:
    """Stages keep unrounded means; for comparison they are rounded like the final results."""
    means = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DecimalType) and f.dataType.scale > 4]
    return df.withColumns({name: rounded(name) for name in means})


_QUERIES: dict[str, Callable[[Roles], DataFrame]] = {
    "load_quarantine": _load_quarantine,
    "dq_rules": lambda r: quality.run_rules(r, quality.standard_rules(PLAY_MINUTES_CAP)),
    "dq_reward_on_failed": lambda r: quality.reward_on_failed(r.reward_logs, r.content_attempts),
    "dq_orphan_multi_parent": _dq_orphan_multi_parent,
    "dq_fk_orphans": _dq_fk_orphans,
    "dq_fk_summary": _dq_fk_summary,
    "dq_pk_duplicates": lambda r: quality.pk_duplicates(r.source("lineitem"), ["l_orderkey", "l_linenumber"]),
    "dq_null_profile": _dq_null_profile,
    "dq_null_profile_all": lambda r: quality.null_profiles(r, TABLES),
    "dq_pk_duplicates_all": lambda r: quality.key_duplicates(r, TABLES),
    "dq_fk_orphans_all": quality.orphan_keys,
    "dq_orphan_attempts": quality.attempt_orphans,
    "table_row_counts": lambda r: profile.row_counts(r, sort=True),
    "date_spans": lambda r: profile.date_spans(profile.standard_date_sources(r)),
    "population_summary": lambda r: profile.population_summary(r.accounts, r.characters),
    "daily_kpis": lambda r: profile.daily_kpis(r.daily_activity),
    "daily_result_distribution": lambda r: profile.daily_result_distribution(r.content_attempts),
    "overall_attempt_summary": lambda r: profile.overall_summary(r.content_attempts),
    "result_share": lambda r: profile.result_share(r.content_attempts),
    "content_health": _health,
    "content_health_rollup": lambda r: health.health_rollup(_health(r)),
    "worst_contents": lambda r: health.worst_contents(_health(r)),
    "active_characters": lambda r: eligibility.active_characters(
        r.daily_activity, r.characters, WINDOW_START, WINDOW_END
    ).select("character_id", "account_id", "level", "combat_power"),
    "eligible_by_content": lambda r: eligibility.eligible_by_content(
        r.daily_activity, r.characters, r.content_master, WINDOW_START, WINDOW_END
    ),
    "attempt_summary": lambda r: _rounded(gap.attempt_summary(r.content_attempts, WINDOW_START, WINDOW_END)),
    "reward_summary": lambda r: _rounded(gap.reward_summary(r.reward_logs, WINDOW_START, WINDOW_END)),
    "retry_summary": lambda r: gap.retry_summary(r.content_attempts, WINDOW_START, WINDOW_END),
    "content_health_gap": _gap,
    "content_health_gap_all_targets": lambda r: _gap(r, "all"),
    "target_lookup": lambda r: targets.target_lookup(r.content_master, r.content_design_goals, LOOKUP_IDS),
    "targets_asof": lambda r: targets.targets_asof(r.content_design_goals, as_of=WINDOW_END),
    "analysis_period": lambda r: usage.analysis_period(r.content_attempts),
    "usage_facts": lambda r: usage.usage_facts(r.content_attempts),
    "active_population": lambda r: usage.active_population(r.daily_activity, r.characters, r.content_attempts),
    "content_usage_overview": _usage,
    "content_usage_overview_all_targets": lambda r: _usage(r, "all"),
    "below_target_contents": _below_target,
    "difficulty_factors_below_target": lambda r: difficulty.difficulty_factors(
        r.content_attempts, r.content_master, r.content_design_goals, ids=_below_target(r)
    ),
    "eligible_participation_below_target": lambda r: participation.eligible_participation(
        r.content_attempts, r.content_master, r.characters, ids=_below_target(r)
    ),
    "power_segments_below_target": lambda r: segments.power_segments(
        r.content_attempts, r.characters, r.content_master, r.content_design_goals, ids=_below_target(r)
    ),
    "difficulty_factors": lambda r: difficulty.difficulty_factors(
        r.content_attempts, r.content_master, r.content_design_goals
    ),
    "eligible_characters": lambda r: eligibility.eligible_characters(r.content_master, r.characters),
    "challengers": lambda r: participation.challengers(r.content_attempts, r.content_master, r.characters),
    "eligible_participation": lambda r: participation.eligible_participation(
        r.content_attempts, r.content_master, r.characters
    ),
    "power_segments": _segments,
    "power_segments_all_targets": lambda r: _segments(r, "all"),
    "rewards_per_attempt": lambda r: rewards.rewards_per_attempt(r.reward_logs),
    "reward_by_result": lambda r: rewards.reward_by_result(
        r.content_attempts, r.reward_logs, FOCUS_CONTENT, r.characters
    ),
    "reward_by_tier": lambda r: rewards.reward_by_tier(
        r.content_attempts, r.reward_logs, r.content_master, FOCUS_TIER
    ),
    "reward_by_line": lambda r: rewards.reward_by_line(
        r.content_attempts, r.reward_logs, r.content_master, FOCUS_LINE
    ),
    "release_maturity": lambda r: release.release_maturity(
        r.content_attempts, r.content_master, r.content_design_goals, FOCUS_CONTENT
    ),
    "band_performance": lambda r: segments.band_performance(
        r.content_attempts, r.characters, r.content_master, r.content_design_goals, FOCUS_CONTENT
    ),
    "pattern_attempts": lambda r: _rounded(
        patterns.pattern_attempts(r.boss_pattern_logs, r.content_attempts, FOCUS_CONTENT, DEFAULT.outcomes)
    ).drop("failed"),
    "pattern_impact": lambda r: patterns.pattern_impact(r.boss_pattern_logs, r.content_attempts, FOCUS_CONTENT),
    "pattern_by_result": lambda r: patterns.pattern_by_result(
        r.boss_pattern_logs, r.content_attempts, FOCUS_CONTENT, FOCUS_PATTERN
    ),
    "pattern_incidence_by_band": lambda r: patterns.pattern_incidence_by_band(
        r.content_attempts,
        r.characters,
        r.content_master,
        r.boss_pattern_logs,
        FOCUS_CONTENT,
        FOCUS_PATTERN,
    ),
}


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(build: Callable[[Roles], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, folder: plain_types(build(Roles(spark, folder)))

    return {name: bind(build) for name, build in _QUERIES.items()}
