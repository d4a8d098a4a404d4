"""Usage overview: participation, shares, outcomes, gaps, ranks and segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playgauge.config import DEFAULT, Outcomes, Settings
from playgauge.functions.classify import difficulty_order, first_match, line_name
from playgauge.functions.counting import outcome_counts, with_distinct_counts, zero_if_missing
from playgauge.functions.exact import mean, mean_of, rate_pct, rounded
from playgauge.functions.period import in_period
from playgauge.operators.eligibility import live_characters
from playgauge.operators.targets import targets_asof

_OUTCOMES = ("clear", "fail", "give_up", "disconnect")
_COUNTED = {
    "participant_account_count": "account_id",
    "participant_character_count": "character_id",
    "party_count": "party_id",
}
_COUNT_COLUMNS = ("attempt_count", *_COUNTED, *(f"{o}_count" for o in _OUTCOMES), "non_clear_count")


def analysis_period(attempts: DataFrame) -> DataFrame:
    """First and last attempt day, one row."""
    return attempts.agg(
        F.min("attempt_started_at").cast("date").alias("start_date"),
        F.max("attempt_started_at").cast("date").alias("end_date"),
    )


def active_population(activity: DataFrame, characters: DataFrame, attempts: DataFrame) -> DataFrame:
    """Accounts, and live characters, that played on any day of the analysis period.

    The period enters the activity scan as two scalar subqueries.
    """
    period = analysis_period(attempts)
    start, end = period.select("start_date").scalar(), period.select("end_date").scalar()
    played = in_period(activity, "activity_date", start, end).filter(F.col("play_minutes") > 0)
    seen = played.select("character_id").distinct()
    live = live_characters(characters).join(seen, "character_id", "left_semi")
    accounts = played.agg(F.count_distinct("account_id").alias("active_account_count"))
    return accounts.withColumn(
        "active_character_count", live.agg(F.count("*").alias("n")).scalar()
    )


def usage_facts(
    attempts: DataFrame, outcomes: Outcomes = DEFAULT.outcomes, max_error: float | None = None
) -> DataFrame:
    """Attempts, participants, outcomes, averages and first and last day per content.

    ``max_error`` allows estimated participants and parties.
    """
    cleared = F.col("result") == outcomes.clear
    facts = attempts.groupBy("content_id").agg(
        F.count("*").alias("attempt_count"),
        *outcome_counts({o: f"{o}_count" for o in _OUTCOMES}, outcomes),
        F.count_if(~cleared).alias("non_clear_count"),
        *(rounded(mean_of(c)).alias(f"avg_{c}") for c in ("death_count", "revive_count", "potion_used_count")),
        rounded(mean_of(F.when(cleared, F.col("clear_time_sec")))).alias("avg_clear_time_sec"),
        rounded(mean_of("party_member_count")).alias("avg_party_member_count"),
        F.min("attempt_started_at").cast("date").alias("first_attempt_date"),
        F.max("attempt_started_at").cast("date").alias("last_attempt_date"),
    )
    return with_distinct_counts(facts, attempts, ["content_id"], _COUNTED, max_error)


def content_base(content: DataFrame, targets: DataFrame, facts: DataFrame, population: DataFrame) -> DataFrame:
    """Active contents with their targets and facts; no attempts means zero counts."""
    targets = targets.select("content_id", *(c for c in targets.columns if c.startswith("target_")))
    return (
        content.filter(F.col("is_active") == 1)
        .join(targets, "content_id", "left")
        .join(facts, "content_id", "left")
        .withColumns(zero_if_missing(*_COUNT_COLUMNS))
        .withColumns(
            {
                "content_line_name": line_name("content_name"),
                "difficulty_order": difficulty_order("difficulty"),
                "active_account_count": population.select("active_account_count").scalar(),
                "active_character_count": population.select("active_character_count").scalar(),
            }
        )
    )


_PEERS = ("content_type", "difficulty")


def _over(aggregate: Column, *keys: str) -> Column:
    """Window aggregate over peers, or over everything without keys.

    Used on one row per content only, after all facts are grouped.
    """
    return aggregate.over(Window.partitionBy(*keys))


def _mean_over(column: str, *keys: str) -> Column:
    return mean(_over(F.sum(column), *keys), _over(F.count(column), *keys))


def usage_metrics(base: DataFrame) -> DataFrame:
    """Rates and shares, rounded; a content without attempts has zero outcome rates."""

    def or_zero(value: Column, count: str) -> Column:
        return F.when(F.col(count) == 0, F.lit(0)).otherwise(value).cast("decimal(20,2)")

    rates = {
        f"{o}_rate_pct": or_zero(rate_pct(f"{o}_count", "attempt_count"), "attempt_count")
        for o in (*_OUTCOMES, "non_clear")
    }
    return base.withColumns(
        {
            "account_participation_rate_pct": rate_pct("participant_account_count", "active_account_count"),
            "character_participation_rate_pct": rate_pct("participant_character_count", "active_character_count"),
            "attempt_share_pct": rate_pct("attempt_count", _over(F.sum("attempt_count"))),
            "participant_account_share_pct": rate_pct(
                "participant_account_count", _over(F.sum("participant_account_count"))
            ),
            **rates,
            "avg_attempts_per_participant_account": or_zero(
                rounded(mean("attempt_count", "participant_account_count")), "participant_account_count"
            ),
        }
    )


def peer_metrics(metrics: DataFrame) -> DataFrame:
    """Gaps to the targets and to peers of the same type and difficulty, and ranks.

    Peer means are taken over the rounded rates.
    """
    rate = "account_participation_rate_pct"

    def ranked(column: str, *keys: str) -> Column:
        return F.rank().over(Window.partitionBy(*keys).orderBy(F.col(column).desc()))

    return metrics.withColumns(
        {
            "participation_rate_gap_pp": rounded(F.col(rate) - F.col("target_participation_rate")),
            "clear_rate_gap_pp": rounded(F.col("clear_rate_pct") - F.col("target_clear_rate")),
            "clear_time_gap_sec": rounded(F.col("avg_clear_time_sec") - F.col("target_avg_clear_time_sec")),
            "peer_participation_gap_pp": rounded(F.col(rate) - _mean_over(rate, *_PEERS)),
            "peer_attempt_gap": rounded(F.col("attempt_count") - _mean_over("attempt_count", *_PEERS)),
            "total_attempt_rank": ranked("attempt_count"),
            "peer_attempt_rank": ranked("attempt_count", *_PEERS),
            "total_participation_rank": ranked(rate),
            "peer_participation_rank": ranked(rate, *_PEERS),
        }
    )


def classify_usage(metrics: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Peer status, target status, and the quadrant of participation against failure."""
    peer_pp, target_pp = F.lit(settings.usage.peer_pp), F.lit(settings.usage.target_pp)
    peer_gap, target_gap = F.col("peer_participation_gap_pp"), F.col("participation_rate_gap_pp")
    rate, burden = F.col("account_participation_rate_pct"), F.col("non_clear_rate_pct")
    averaged = metrics.withColumns(
        {
            "_rate_mean": _mean_over("account_participation_rate_pct"),
            "_burden_mean": _mean_over("non_clear_rate_pct"),
        }
    )
    much_used, burdened = rate >= F.col("_rate_mean"), burden >= F.col("_burden_mean")
    return averaged.withColumns(
        {
            "participation_status": first_match(
                [
                    (F.col("attempt_count") == 0, "UNUSED"),
                    (peer_gap <= -peer_pp, "BELOW_PEERS"),
                    (peer_gap >= peer_pp, "ABOVE_PEERS"),
                ],
                "NEAR_PEERS",
            ),
            "target_participation_status": first_match(
                [(target_gap <= -target_pp, "BELOW_TARGET"), (target_gap >= target_pp, "ABOVE_TARGET")],
                "NEAR_TARGET",
            ),
            "usage_failure_segment": first_match(
                [
                    (much_used & burdened, "HIGH_USE_HIGH_FAILURE"),
                    (~much_used & ~burdened, "LOW_USE_LOW_FAILURE"),
                    (~much_used & burdened, "LOW_USE_HIGH_FAILURE"),
                    (much_used & ~burdened, "HIGH_USE_LOW_FAILURE"),
                ],
                "OTHER",
            ),
        }
    ).drop("_rate_mean", "_burden_mean")


COLUMNS = (
    "content_id",
    "content_line_name",
    "content_name",
    "content_type",
    "difficulty",
    "difficulty_order",
    "required_level",
    "recommended_combat_power",
    "min_party_size",
    "max_party_size",
    "entry_limit_type",
    "entry_limit_count",
    "expected_clear_time_sec",
    "active_account_count",
    "active_character_count",
    "attempt_count",
    *_COUNTED,
    "account_participation_rate_pct",
    "character_participation_rate_pct",
    "attempt_share_pct",
    "participant_account_share_pct",
    "avg_attempts_per_participant_account",
    "target_participation_rate",
    "participation_rate_gap_pp",
    *(f"{o}_count" for o in (*_OUTCOMES, "non_clear")),
    *(f"{o}_rate_pct" for o in (*_OUTCOMES, "non_clear")),
    "target_clear_rate",
    "clear_rate_gap_pp",
    "avg_death_count",
    "avg_revive_count",
    "avg_potion_used_count",
    "avg_clear_time_sec",
    "target_avg_clear_time_sec",
    "clear_time_gap_sec",
    "avg_party_member_count",
    "peer_participation_gap_pp",
    "peer_attempt_gap",
    "total_attempt_rank",
    "peer_attempt_rank",
    "total_participation_rank",
    "peer_participation_rank",
    "first_attempt_date",
    "last_attempt_date",
    "participation_status",
    "target_participation_status",
    "usage_failure_segment",
)


def usage_overview(
    attempts: DataFrame,
    activity: DataFrame,
    characters: DataFrame,
    content: DataFrame,
    goals: DataFrame,
    settings: Settings = DEFAULT,
    target_mode: str = "latest",
) -> DataFrame:
    """The full overview, one row per active content (and per goal version in mode ``all``)."""
    base = content_base(
        content,
        targets_asof(goals, keys=["content_id"], mode=target_mode),
        usage_facts(attempts, settings.outcomes),
        active_population(activity, characters, attempts),
    )
    return (
        classify_usage(peer_metrics(usage_metrics(base)), settings)
        .select(*COLUMNS)
        .orderBy("total_attempt_rank", "content_type", "difficulty_order", "content_id")
    )


def below_target(
    attempts: DataFrame,
    content: DataFrame,
    goals: DataFrame,
    settings: Settings = DEFAULT,
    target_mode: str = "latest",
) -> DataFrame:
    """``select_below_target`` of the overview, from the attempts' outcomes alone: one scan of two columns."""
    tried = attempts.groupBy("content_id").agg(
        F.count("*").alias("attempt_count"), *outcome_counts({"clear": "clear_count"}, settings.outcomes)
    )
    targets = targets_asof(goals, keys=["content_id"], mode=target_mode).select("content_id", "target_clear_rate")
    # A content without attempts has a rate of zero.
    rate = F.coalesce(rate_pct("clear_count", "attempt_count"), F.lit(0)).cast("decimal(20,2)")
    gaps = (
        content.filter(F.col("is_active") == 1)
        .select("content_id")
        .join(targets, "content_id")
        .join(tried, "content_id", "left")
        .select("content_id", rounded(rate - F.col("target_clear_rate")).alias("clear_rate_gap_pp"))
    )
    return select_below_target(gaps)


def select_below_target(usage: DataFrame) -> DataFrame:
    """Ids of the contents whose clear rate misses its target, widest gap first."""
    below = usage.filter(F.col("clear_rate_gap_pp") < 0)
    return below.orderBy("clear_rate_gap_pp", "content_id").select("content_id")
