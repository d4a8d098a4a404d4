"""Data-quality jobs: row rules, orphans, duplicate keys, null profile."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playgauge.config import CLEAR_REWARD_SOURCE, DEFAULT, MAX_PLAY_MINUTES_PER_DAY, Outcomes
from playgauge.sources.schemas import Table


@dataclass(frozen=True)
class Rule:
    """A named SQL condition that no row of ``table`` should meet."""

    name: str
    table: str
    condition: str


def standard_rules(max_play_minutes: int = MAX_PLAY_MINUTES_PER_DAY, outcomes: Outcomes = DEFAULT.outcomes) -> list[Rule]:
    return [
        Rule("invalid_playtime_over_24h", "daily_activity", f"play_minutes > {max_play_minutes}"),
        Rule("invalid_attempt_time_reverse", "content_attempts", "attempt_ended_at < attempt_started_at"),
        Rule(
            "invalid_clear_without_clear_time",
            "content_attempts",
            f"result = '{outcomes.clear}' AND clear_time_sec IS NULL",
        ),
        Rule("invalid_refund_time_reverse", "payments", "refund_at < paid_at"),
    ]


def run_rules(tables: Mapping[str, DataFrame], rules: Sequence[Rule]) -> DataFrame:
    """Violations per rule. All rules of one table share one scan and one aggregate."""
    by_table: dict[str, list[Rule]] = {}
    for rule in rules:
        by_table.setdefault(rule.table, []).append(rule)
    counted = []
    for name, group in by_table.items():
        row = tables[name].agg(*(F.count_if(F.expr(r.condition)).alias(r.name) for r in group))
        counted.append(row.unpivot([], [r.name for r in group], "rule", "violations"))
    return reduce(DataFrame.unionByName, counted)


def reward_on_failed(
    rewards: DataFrame,
    attempts: DataFrame,
    source: str = CLEAR_REWARD_SOURCE,
    outcomes: Outcomes = DEFAULT.outcomes,
) -> DataFrame:
    """Clear rewards paid for attempts that were failed or given up."""
    per_attempt = (
        rewards.filter((F.col("reward_source") == source) & F.col("attempt_id").isNotNull())
        .groupBy("attempt_id")
        .agg(F.count("*").alias("rows"))
    )
    lost = attempts.filter(F.col("result").isin(outcomes.fail, outcomes.give_up)).select("attempt_id")
    return per_attempt.join(lost, "attempt_id").agg(
        F.lit("invalid_reward_on_failed_attempt").alias("rule"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("violations"),
    )


@dataclass(frozen=True)
class Parent:
    """A parent table and the child column that should point into it."""

    column: str
    frame: DataFrame
    key: str


def orphans_multi(fact: DataFrame, parents: Sequence[Parent]) -> DataFrame:
    """Number of fact rows that miss at least one parent; a NULL reference misses.

    Rows are first reduced to their distinct reference combinations with a row
    count, so the joins move combinations, not facts. Combinations with a NULL miss
    without a join; the others are complete if they survive a semi join with every
    parent, whose keys may repeat.
    """
    columns = list(dict.fromkeys(p.column for p in parents))
    combos = fact.groupBy(*columns).agg(F.count("*").alias("_rows"))
    complete = combos.dropna("any", subset=columns)
    for parent in parents:
        known = parent.frame.select(F.col(parent.key).alias(parent.column))
        complete = complete.join(known, parent.column, "left_semi")
    whole = fact.agg(F.count("*").alias("_rows"))
    both = whole.unionByName(complete.select((-F.col("_rows")).alias("_rows")))
    return both.agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("orphan_rows"))


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str, ignore_null: bool = False) -> DataFrame:
    """The reference column of every child row without a parent, one row per child row."""
    refs = child.select(column)
    if ignore_null:
        refs = refs.filter(F.col(column).isNotNull())
    return refs.join(parent.select(F.col(key).alias(column)), column, "left_anti")


@dataclass(frozen=True)
class Reference:
    """One reference to check: child table and column, parent table and key."""

    child: str
    column: str
    parent: str
    key: str
    ignore_null: bool = False

    @property
    def label(self) -> str:
        return f"{self.child}.{self.column}->{self.parent}.{self.key}"


STANDARD_REFERENCES = (
    Reference("characters", "account_id", "accounts", "account_id"),
    Reference("content_attempts", "character_id", "characters", "character_id"),
    Reference("content_attempts", "content_id", "content_master", "content_id"),
    Reference("boss_pattern_logs", "attempt_id", "content_attempts", "attempt_id"),
    Reference("reward_logs", "attempt_id", "content_attempts", "attempt_id", ignore_null=True),
)


def orphan_summary(
    tables: Mapping[str, DataFrame], references: Sequence[Reference] = STANDARD_REFERENCES
) -> DataFrame:
    """Orphan rows per reference.

    Child rows are counted per referenced key before the anti join: a key that
    holds very many rows is one row by then.
    """

    def one(ref: Reference) -> DataFrame:
        refs = tables[ref.child].groupBy(ref.column).agg(F.count("*").alias("_rows"))
        if ref.ignore_null:
            refs = refs.filter(F.col(ref.column).isNotNull())
        parent = tables[ref.parent].select(F.col(ref.key).alias(ref.column))
        return refs.join(parent, ref.column, "left_anti").agg(
            F.lit(ref.label).alias("fk"), F.coalesce(F.sum("_rows"), F.lit(0)).alias("orphan_rows")
        )

    return reduce(DataFrame.unionByName, [one(ref) for ref in references])


def pk_duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that occur more than once, with their row count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def null_profile(df: DataFrame, table: Table) -> DataFrame:
    """Per declared column: NULLs, NULLs that break NOT NULL, texts that are too long.

    A column that the rows don't have is NULL in all of them.
    """
    absent = [c for c in table.columns if c.name not in df.columns]
    df = df.withColumns({c.name: F.lit(None).cast(c.data_type) for c in absent})
    counts = [F.count("*").alias("_rows")]
    for c in table.columns:
        counts.append(F.count_if(F.col(c.name).isNull()).alias(f"{c.name}_nulls"))
        if c.max_length is not None:
            long_text = F.char_length(c.name) > c.max_length
            counts.append(F.count_if(long_text).alias(f"{c.name}_long"))
    zero = F.lit(0).cast("bigint")
    lines = [
        F.struct(
            F.lit(table.name).alias("table_name"),
            F.lit(c.name).alias("column_name"),
            F.col("_rows").alias("row_count"),
            F.col(f"{c.name}_nulls").alias("nulls"),
            (F.col(f"{c.name}_nulls") if c.required else zero).alias("null_violations"),
            (F.col(f"{c.name}_long") if c.max_length is not None else zero).alias("over_length"),
        )
        for c in table.columns
    ]
    return df.agg(*counts).select(F.inline(F.array(*lines)))


def null_profiles(tables: Mapping[str, DataFrame], declared: Mapping[str, Table]) -> DataFrame:
    """``null_profile`` of every declared table."""
    return reduce(DataFrame.unionByName, [null_profile(tables[name], table) for name, table in declared.items()])


def key_duplicates(tables: Mapping[str, DataFrame], declared: Mapping[str, Table]) -> DataFrame:
    """Values of every declared key that occur more than once, with their row count.

    Keys are text, NULLs in them the word NULL. A table that lacks a column of its key has one row, which names the
    column and has no count.
    """

    def one(table: Table) -> DataFrame:
        df = tables[table.name]
        absent = [name for name in table.key if name not in df.columns]
        if absent:
            told = F.lit(f"absent: {', '.join(absent)}").alias("key_value")
            one_row = df.sparkSession.range(1, numPartitions=1)
            return one_row.select(F.lit(table.name).alias("table_name"), told, F.lit(None).cast("bigint").alias("n"))
        value = F.concat_ws(",", *(F.coalesce(F.col(name).cast("string"), F.lit("NULL")) for name in table.key))
        return pk_duplicates(df, table.key).select(F.lit(table.name).alias("table_name"), value.alias("key_value"), "n")

    return reduce(DataFrame.unionByName, [one(table) for table in declared.values() if table.key])


def orphan_keys(tables: Mapping[str, DataFrame], references: Sequence[Reference] = STANDARD_REFERENCES) -> DataFrame:
    """Every referenced key without a parent, by reference, with its number of child rows."""

    def one(ref: Reference) -> DataFrame:
        refs = tables[ref.child].groupBy(ref.column).agg(F.count("*").alias("orphan_rows"))
        if ref.ignore_null:
            refs = refs.filter(F.col(ref.column).isNotNull())
        parent = tables[ref.parent].select(F.col(ref.key).alias(ref.column))
        lost = refs.join(parent, ref.column, "left_anti")
        return lost.select(F.lit(ref.label).alias("fk"), F.col(ref.column).alias("orphan_key"), "orphan_rows")

    return reduce(DataFrame.unionByName, [one(ref) for ref in references])


def attempt_orphans(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Number of attempts that miss their account, character or content."""
    parents = (("account_id", "accounts"), ("character_id", "characters"), ("content_id", "content_master"))
    return orphans_multi(tables["content_attempts"], [Parent(key, tables[name], key) for key, name in parents])
