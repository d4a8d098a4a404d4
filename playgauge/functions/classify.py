"""Bands, ordered rules and tier helpers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from playgauge.config import (
    DEFAULT,
    DIFFICULTY_ORDER,
    TIER_SUFFIX_PATTERN,
    UNKNOWN_DIFFICULTY_ORDER,
    PowerBands,
)
from playgauge.functions.exact import as_column


def first_match(rules: Sequence[tuple[Column, object]], default: object) -> Column:
    """Label of the first rule that is true; NULL conditions count as not true."""
    (condition, label), *rest = rules
    chain = reduce(lambda acc, rule: acc.when(rule[0], F.lit(rule[1])), rest, F.when(condition, F.lit(label)))
    return chain.otherwise(F.lit(default))


def power_band(power: Column | str, recommended: Column | str, bands: PowerBands = DEFAULT.bands) -> Column:
    """Band of ``power`` relative to ``recommended``.

    Edges are compared by multiplication, which is exact in decimals. Without
    a usable recommendation there is no ratio, and the row goes to the top band.
    """
    power, recommended = as_column(power), as_column(recommended)
    top = bands.labels[-1]
    no_ratio = recommended.isNull() | (recommended == 0)
    edges = [(power < recommended * F.lit(cut), label) for cut, label in zip(bands.cuts, bands.labels)]
    return first_match([(no_ratio, top), *edges], top)


def difficulty_order(difficulty: Column | str) -> Column:
    difficulty = as_column(difficulty)
    return first_match(
        [(difficulty == name, order) for name, order in DIFFICULTY_ORDER.items()],
        UNKNOWN_DIFFICULTY_ORDER,
    )


def line_name(content_name: Column | str) -> Column:
    """Content name without its tier suffix. Patterns need a plain text column, so a collation is dropped."""
    return F.regexp_replace(F.collate(as_column(content_name), "UTF8_BINARY"), TIER_SUFFIX_PATTERN, "")
