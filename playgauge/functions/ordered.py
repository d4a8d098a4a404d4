"""Running totals and ranks over rows of any number, without a window that holds them all.

Rows are first added up by value, so equal values are one row. The values' range is cut into blocks at estimated
quantiles: a bounded array, found once. A block's rows are summed by themselves in order, and every block adds what the
blocks before it hold. No task gets more than a block, and only one row per block meets the others.

The cuts decide where blocks end, never a result: totals and ranks are exact for any cuts. NULL values come last.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playgauge.functions.exact import as_column

#: Blocks that the range of values is cut into.
BLOCKS = 256


def cuts(df: DataFrame, value: str, blocks: int = BLOCKS) -> Column:
    """Ascending values, at most ``blocks - 1`` of them, that cut the rows' values into like parts; one scalar."""
    shares = F.array(*(F.lit(i / blocks) for i in range(1, blocks)))
    found = F.percentile_approx(value, shares, 10 * blocks)
    return df.agg(F.coalesce(F.array_distinct(found), F.array()).alias("cuts")).scalar()


def block_of(value: Column | str, edges: Column | str, blocks: int = BLOCKS) -> Column:
    """How many of the ascending ``edges`` are at or below the value; -1 for NULL."""
    value, edges = as_column(value), as_column(edges)
    steps = [1 << k for k in reversed(range(blocks.bit_length()))]
    at = F.aggregate(
        F.array(*map(F.lit, steps)),
        F.lit(0),
        lambda at, step: F.when(F.get(edges, at + step - 1) <= value, at + step).otherwise(at),
    )
    return F.when(value.isNull(), -1).otherwise(at)


def running_totals(
    df: DataFrame, value: str, amounts: Sequence[str], keys: Sequence[str] = (), blocks: int = BLOCKS
) -> DataFrame:
    """One row per key and value: each amount's total over it (``a``) and over all greater values of its key
    (``a_above``); amounts are whole numbers, and a key or value may hold any share of the rows."""
    each = df.groupBy(*keys, value).agg(*(F.sum(a).alias(a) for a in amounts))
    each = each.withColumn("_edges", cuts(df, value, blocks)).withColumn("_block", block_of(value, "_edges", blocks)).drop("_edges")
    totals = each.groupBy(*keys, "_block").agg(*(F.sum(a).alias(f"{a}_total") for a in amounts))
    above = Window.partitionBy(*keys, F.lit(0)).orderBy(F.col("_block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "_block", *(F.coalesce(F.sum(f"{a}_total").over(above), F.lit(0)).alias(f"{a}_before") for a in amounts))
    inside = Window.partitionBy(*keys, "_block").orderBy(F.col(value).desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    summed = each.withColumns({f"{a}_inside": F.coalesce(F.sum(a).over(inside), F.lit(0)) for a in amounts})
    same = F.col("e._block") == F.col("t._block")
    for key in keys:
        same = same & F.col(f"e.{key}").eqNullSafe(F.col(f"t.{key}"))
    joined = summed.alias("e").join(totals.alias("t"), same)
    return joined.select(
        *(f"e.{k}" for k in keys),
        f"e.{value}",
        *(f"e.{a}" for a in amounts),
        *((F.col(f"e.{a}_inside") + F.col(f"t.{a}_before")).alias(f"{a}_above") for a in amounts),
    )


def with_rank(df: DataFrame, value: str, name: str, keys: Sequence[str] = (), blocks: int = BLOCKS) -> DataFrame:
    """The rows with their rank by falling value (1 for the greatest, ties alike, NULL last) within each key."""
    counted = df.select(*keys, value, F.lit(1).cast("bigint").alias("_n"))
    ranks = running_totals(counted, value, ["_n"], keys, blocks)
    left, right = df.alias("d"), ranks.alias("r")
    same = F.col(f"d.{value}").eqNullSafe(F.col(f"r.{value}"))
    for key in keys:
        same = same & F.col(f"d.{key}").eqNullSafe(F.col(f"r.{key}"))
    return left.join(right, same).select("d.*", (F.col("r._n_above") + 1).cast("int").alias(name))
