"""Counting helpers shared by the grouped operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playgauge.config import DEFAULT, Outcomes
from playgauge.functions.exact import as_column


def outcome_counts(
    names: Mapping[str, str],
    outcomes: Outcomes = DEFAULT.outcomes,
    column: str = "result",
) -> list[Column]:
    """One conditional count per outcome; ``names`` maps outcome to output name."""
    return [
        F.count_if(F.col(column) == getattr(outcomes, outcome)).alias(alias)
        for outcome, alias in names.items()
    ]


def with_distinct_counts(
    aggregated: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    counted: Mapping[str, Column | str],
    max_error: float | None = None,
) -> DataFrame:
    """Add distinct counts of integer ids to an aggregate of ``source``.

    Several distinct counts inside one ``agg`` make every shuffled row carry
    the buffers of all the other aggregates. Here the ids travel alone as
    narrow (keys, kind, id) rows: they are deduplicated on the map side, spread
    by id, so a hot key does not land in one task, and counted after that. The
    aggregate itself shuffles only one row per key and map task.

    Counts are exact unless ``max_error`` gives a relative standard error; then
    sketches are used and no ids are shuffled at all.
    """
    counts = (
        _exact_counts(source, keys, counted)
        if max_error is None
        else source.groupBy(*keys).agg(
            *(F.approx_count_distinct(as_column(v), max_error).alias(alias) for alias, v in counted.items())
        )
    )
    if not keys:
        return aggregated.withColumns({alias: counts.select(alias).scalar() for alias in counted})
    left, right = aggregated.alias("agg"), counts.alias("ids")
    same_group = reduce(and_, (F.col(f"agg.{k}").eqNullSafe(F.col(f"ids.{k}")) for k in keys))
    return left.join(right, same_group, "left").select(
        "agg.*", *(F.coalesce(F.col(f"ids.{a}"), F.lit(0)).alias(a) for a in counted)
    )


def _exact_counts(source: DataFrame, keys: Sequence[str], counted: Mapping[str, Column | str]) -> DataFrame:
    values = [as_column(value).cast("bigint") for value in counted.values()]
    pairs = [part for kind, value in enumerate(values) for part in (F.lit(kind), value)]
    ids = source.select(*keys, F.stack(F.lit(len(values)), *pairs).alias("kind", "id"))
    return (
        ids.filter(F.col("id").isNotNull())
        .distinct()
        .groupBy(*keys)
        .agg(*(F.count_if(F.col("kind") == kind).alias(alias) for kind, alias in enumerate(counted)))
    )


def zero_if_missing(*names: str) -> dict[str, Column]:
    return {name: F.coalesce(F.col(name), F.lit(0)) for name in names}
