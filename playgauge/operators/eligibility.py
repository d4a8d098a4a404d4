"""How many characters meet the level and power requirements of each content."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import date
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from playgauge.functions.ordered import BLOCKS, running_totals
from playgauge.functions.period import in_period

#: Different levels, and different powers, up to which the requirements are kept in arrays.
MOST_EDGES = 256


def _power_type(content: DataFrame, characters: DataFrame, shares: Iterable[Decimal | None]) -> str:
    """A type that holds every power and every share of a recommended power without rounding."""
    kinds = [content.schema["recommended_combat_power"].dataType, characters.schema["combat_power"].dataType]
    if any(isinstance(k, (T.FloatType, T.DoubleType)) for k in kinds):
        return "double"
    scales = [k.scale if isinstance(k, T.DecimalType) else 0 for k in kinds]
    digits = max((-Decimal(str(s)).normalize().as_tuple().exponent for s in shares if s is not None), default=0)
    return f"decimal(38,{max(scales[0] + max(digits, 0), scales[1])})"


def _met(edges: str, steps: str, value: Column) -> Column:
    """How many of the ascending ``edges`` are at or below ``value``.

    Binary search over the array: each step, a descending power of two, tries
    to move that far ahead. The cost per row grows with the logarithm of the
    number of edges.
    """

    def move(position: Column, step: Column) -> Column:
        reach = position + step
        return F.when(F.get(F.col(edges), reach - 1) <= value, reach).otherwise(position)

    return F.aggregate(F.col(steps), F.lit(0), move)


def _steps(edges: Column) -> Column:
    """Descending powers of two that together cover the length of ``edges``."""
    top = F.ceil(F.log2(F.size(edges) + F.lit(1.0))).cast("int")
    return F.transform(F.sequence(top, F.lit(0)), lambda k: F.pow(F.lit(2), k).cast("int"))


def threshold_counts(
    content: DataFrame,
    characters: DataFrame,
    requirements: Mapping[str, Decimal | None],
    most_edges: int = MOST_EDGES,
    blocks: int = BLOCKS,
) -> DataFrame:
    """Per content, the characters at or above its level and a share of its power.

    ``requirements`` maps an output name to the share of the recommended power
    that is needed, or to None where the level alone decides. ``characters``
    holds each character once.

    Characters never meet contents row by row. The different thresholds are counted
    first, in one small job over the contents. Up to ``most_edges`` of them per axis are
    kept in arrays (``_by_cells``); beyond that, thresholds and characters are sorted
    together by range (``_by_ranges``). Both are exact.
    """
    power_type = _power_type(content, characters, requirements.values())
    asks = content.select(
        "content_id",
        F.col("required_level").cast("int").alias("level_edge"),
        F.inline(
            F.array(
                *(
                    F.struct(
                        F.lit(name).alias("requirement"),
                        (F.col("recommended_combat_power") * F.lit(share) if share is not None else F.lit(None))
                        .cast(power_type)
                        .alias("power_edge"),
                        F.lit(share is not None).alias("needs_power"),
                    )
                    for name, share in requirements.items()
                )
            )
        ),
    )
    size = asks.agg(
        F.count_distinct("level_edge").alias("levels"),
        F.count_distinct("power_edge").alias("powers"),
        F.min("level_edge").alias("low"),
        F.max("level_edge").alias("high"),
    ).first()
    people = characters.select(F.col("level").cast("int").alias("level"), F.col("combat_power").cast(power_type).alias("power"))
    if max(size["levels"], size["powers"]) <= most_edges:
        answered = _by_cells(asks, people)
    else:
        answered = _by_ranges(asks, people, size["low"], size["high"], blocks)
    return answered.groupBy("content_id").agg(
        *(
            F.coalesce(F.max(F.when(F.col("requirement") == name, F.col("n"))), F.lit(0)).alias(name)
            for name in requirements
        )
    )


def _by_ranges(asks: DataFrame, people: DataFrame, low: int, high: int, blocks: int) -> DataFrame:
    """``content_id``, ``requirement`` and ``n`` for any number of thresholds.

    Levels from a threshold up are a few nodes of a binary tree over the levels between the least and the greatest
    threshold: the threshold's own leaf, and the right sibling wherever its path goes left. People of one level and
    power are one row, and count for every node on their path. Within a node, how many reach a power is a running
    total by falling power, summed in blocks; people without a power come last, where only requirements without one
    ask.
    """
    height = (high - low).bit_length()
    apart = 1 << 40  # nodes of one height are numbered below this

    def node(h: int, at: Column) -> Column:
        return F.lit(h * apart) + at

    place = F.least(F.col("level"), F.lit(high)) - F.lit(low)
    points = people.filter(F.col("level") >= low).groupBy(place.cast("bigint").alias("at"), "power").agg(F.count("*").alias("n"))
    path = F.array(*(node(h, F.shiftright("at", h)) for h in range(height + 1)))
    points = points.select(F.explode(path).alias("node"), "power", "n")

    known = asks.filter(F.col("level_edge").isNotNull() & (~F.col("needs_power") | F.col("power_edge").isNotNull()))
    known = known.withColumn("power", F.when(F.col("needs_power"), F.col("power_edge")))
    at = (F.col("level_edge") - F.lit(low)).cast("bigint")
    right = [F.when(F.shiftright("at", h) % 2 == 0, node(h, F.shiftright("at", h) + 1)) for h in range(height)]
    # Contents of equal thresholds ask once.
    each = known.select(at.alias("at"), "power").distinct()
    each = each.withColumn("node", F.explode(F.array_compact(F.array(node(0, F.col("at")), *right))))
    table = running_totals(points.unionByName(each.select("node", "power", F.lit(0).cast("bigint").alias("n"))), "power", ["n"], ["node"], blocks)
    same = (F.col("e.node") == F.col("t.node")) & F.col("e.power").eqNullSafe(F.col("t.power"))
    sums = each.alias("e").join(table.alias("t"), same).groupBy("e.at", "e.power").agg(F.sum(F.col("t.n") + F.col("t.n_above")).alias("n"))
    asked = known.select("content_id", "requirement", at.alias("at"), "power").alias("a")
    same = (F.col("a.at") == F.col("s.at")) & F.col("a.power").eqNullSafe(F.col("s.power"))
    found = asked.join(sums.alias("s"), same).select("a.content_id", "a.requirement", "s.n")
    # A missing requirement is met by nobody.
    rest = asks.filter(F.col("level_edge").isNull() | (F.col("needs_power") & F.col("power_edge").isNull()))
    return found.unionByName(rest.select("content_id", "requirement", F.lit(0).cast("bigint").alias("n")))


def _by_cells(asks: DataFrame, people: DataFrame) -> DataFrame:
    """``content_id``, ``requirement`` and ``n`` where the thresholds fit in arrays.

    Each character is placed in a cell by the number of distinct level and power thresholds it reaches, and
    only the cell counts are shuffled. A content then asks for the sum of all cells at or beyond its own two
    thresholds, which a running sum over the cells gives. The edges of the cells are the thresholds.
    """
    sorted_edges = asks.agg(
        F.array_sort(F.collect_set("level_edge")).alias("levels"),
        F.array_sort(F.collect_set("power_edge")).alias("powers"),
    )
    edges = {
        "levels": sorted_edges.select("levels").scalar(),
        "powers": sorted_edges.select("powers").scalar(),
        "level_steps": sorted_edges.select(_steps(F.col("levels"))).scalar(),
        "power_steps": sorted_edges.select(_steps(F.col("powers"))).scalar(),
    }
    cells = (
        people.withColumns(edges)
        .select(
            _met("levels", "level_steps", F.col("level")).alias("level_rank"),
            _met("powers", "power_steps", F.col("power")).alias("power_rank"),
        )
        .groupBy("level_rank", "power_rank")
        .agg(F.count("*").alias("n"))
    )

    ranked = asks.withColumns({name: edges[name] for name in ("levels", "powers")}).select(
        "content_id",
        "requirement",
        F.array_position("levels", F.col("level_edge")).cast("int").alias("level_rank"),
        F.when(F.col("needs_power"), F.array_position("powers", F.col("power_edge")))
        .otherwise(0)
        .cast("int")
        .alias("power_rank"),
    )
    # A cell counts for every level edge up to its own; nothing asks for rank 0.
    reached = (
        cells.select(F.explode(F.sequence(F.lit(0), "level_rank")).alias("level_rank"), "power_rank", "n")
        .groupBy("level_rank", "power_rank")
        .agg(F.sum("n").alias("n"))
    )
    from_here_up = (
        Window.partitionBy("level_rank")
        .orderBy(F.col("power_rank").desc())
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    # The asks run along in the window with a count of nothing and read the sum there;
    # a missing requirement has no rank and is met by nobody.
    known = F.col("level_rank").isNotNull() & F.col("power_rank").isNotNull()
    return (
        ranked.withColumn("n", F.lit(0).cast("bigint"))
        .unionByName(reached, allowMissingColumns=True)
        .withColumn("n", F.when(known, F.sum("n").over(from_here_up)))
        .filter(F.col("content_id").isNotNull())
        .select("content_id", "requirement", "n")
    )


def live_characters(characters: DataFrame) -> DataFrame:
    return characters.filter(F.col("is_deleted") == 0)


def active_characters(activity: DataFrame, characters: DataFrame, start: date, end: date) -> DataFrame:
    """Live characters with any activity in the window, each once."""
    seen = in_period(activity, "activity_date", F.lit(start), F.lit(end)).select("character_id").distinct()
    return live_characters(characters).join(seen, "character_id", "left_semi")


def eligible_by_content(
    activity: DataFrame, characters: DataFrame, content: DataFrame, start: date, end: date
) -> DataFrame:
    """Characters active in the window that may enter, and that have the recommended power."""
    return threshold_counts(
        content.filter(F.col("is_active") == 1),
        active_characters(activity, characters, start, end),
        {"eligible_character_count": None, "recommended_ready_character_count": Decimal("1")},
    )


def eligible_characters(
    content: DataFrame, characters: DataFrame, near_ready_share: Decimal = Decimal("0.8")
) -> DataFrame:
    """Live characters at the full and at the near-ready power, whether active or not."""
    return threshold_counts(
        content.filter(F.col("is_active") == 1),
        live_characters(characters),
        {"eligible_character_count_100": Decimal("1"), "eligible_character_count_80": near_ready_share},
    )
