"""Mixing sources to target weights by weighted fair queueing.

Each document of a source, in an order shuffled by hash, may be read up to ``max_epochs`` times. A
reading's virtual finish time is the source's words up to its end, divided by the source's weight. All
readings, sorted by finish time across sources, are taken until the budget is spent; the last one
taken is cut to the words left. A source that runs out leaves its share to the others by weight,
which is what water-filling gives, so the targets are computed in closed form beside the queue.

Running sums never gather a source, or all readings, in one task: rows are dealt to slices of bounded
size, the slices' sums are added up, and rows add their own place within the slice.

Nulls and unusual input: a null text has no words; null sources form one source, the last in order.
Documents without words are never taken. Null or repeated ``doc_id`` values are rows like others; rows
equal in source, id and size are interchangeable. An empty table gives an empty result. ``mix`` reads no further
columns; ``mixed_documents`` gives them back as they were, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playgauge.llm.common import field, stored

#: Readings in one slice of a running sum, about.
SLICE_ROWS = 20_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str = "text") -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def shuffled(seed: int) -> Column:
    """A place in the shuffled order, of 60 bits, by the document's id."""
    named = F.concat_ws(":", F.lit(seed).cast("string"), F.col("doc_id").cast("string"))
    return F.conv(F.substring(F.md5(named.cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), budget_share: float = 1.5, max_epochs: int = 2
) -> DataFrame:
    """One row per source: its rows, words, weight and target words.

    Weights go round the sources in code point order, null last. Targets share ``budget_share`` of all
    words by weight and stop at ``max_epochs`` times a source's words; what is over goes to the others.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    per = per.withColumn("weight", F.element_at(cycle, (place % len(weights) + 1).cast("int")))
    cap = F.col("source_size") * float(max_epochs)
    # Sources in the order in which they run out; before[k] have run out when the k-th does.
    full = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    whole = Window.partitionBy()
    per = per.withColumn("cap", cap).withColumns(
        {
            "capped": F.coalesce(F.sum("cap").over(full.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "open": F.sum("weight").over(full.rowsBetween(0, Window.unboundedFollowing)),
            "budget": F.floor(F.sum("source_size").over(whole) * float(budget_share)),
        }
    )
    level = (F.col("budget") - F.col("capped")) / F.col("open")
    # The final level is the first at which the next source to run out doesn't.
    reached = F.when(level * F.col("weight") <= F.col("cap"), level)
    at = F.row_number().over(full)
    per = per.withColumns({"_at": at, "_reached": reached}).withColumn(
        "level", F.min_by("_reached", F.when(F.col("_reached").isNotNull(), F.col("_at"))).over(whole)
    )
    share = F.when(F.col("level").isNull(), F.col("cap")).otherwise(
        F.least(F.col("cap"), F.col("level") * F.col("weight"))
    )
    return per.select("source", "source_size", "source_rows", "weight", "budget", share.alias("target"))


def _running(df: DataFrame, keys: list[str], slice_: Column, order: list[Column | str], size: str, to: str) -> DataFrame:
    """Adds the sum of ``size`` up to and with each row, within ``keys``, by slice and then order."""
    df = df.withColumn("_slice", slice_)
    sums = df.groupBy(*keys, "_slice").agg(F.sum(size).alias("_sum"))
    upto = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(upto), F.lit(0).cast("long")))
    same = F.col("a._slice") == F.col("b._slice")
    for key in keys:
        same = same & F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}"))
    joined = df.alias("a").join(sums.alias("b"), same).select("a.*", "b._before")
    own = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumn(to, F.col("_before") + F.sum(size).over(own)).drop("_slice", "_before")


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    budget_share: float = 1.5,
    max_epochs: int = 2,
    seed: int = 7,
) -> DataFrame:
    """One row per document, without its text, with what the mix takes of it.

    Reads doc_id, source and text. Gives doc_id, source, ``text_key`` (a hash of the text), size,
    source_size, target (of the source), ``readings`` (taken as a whole) and ``taken`` (words, including
    the last reading's cut one).
    """
    # Texts are counted once; what follows reads the counts.
    sizes = stored(docs.select("doc_id", "source", F.xxhash64("text").alias("text_key"), word_count().alias("size")), "mix-sizes")
    targets = source_targets(sizes, weights, budget_share, max_epochs)
    rows = (
        sizes.alias("s")
        .join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source")))
        .select("s.*", "t.source_size", "t.source_rows", "t.weight", "t.target", "t.budget")
        .withColumn("_mix", shuffled(seed))
    )
    # Slices are equal parts of the hash range, in its order.
    slices = F.ceil(F.col("source_rows") / SLICE_ROWS)
    part = F.floor(F.col("_mix") / F.lit(2.0**60) * slices).cast("long")
    order = ["_mix", "doc_id", "size", "text_key"]
    rows = _running(rows, ["source"], part, order, "size", "_upto")
    readings = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))))
    end = F.col("_upto") + F.col("epoch") * F.col("source_size")
    readings = readings.withColumn("finish", end / F.col("weight"))
    # Sorted by range across all sources; written down, so that ranges can't shift when a task runs again.
    by = ["finish", "_mix", "doc_id", "epoch"]
    ordered = stored(
        readings.repartitionByRange(*by).withColumn("_range", F.spark_partition_id().cast("long")), "mix-queue"
    )
    spent = _running(ordered, [], F.col("_range"), by, "size", "_spent")
    words = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("budget") - (F.col("_spent") - F.col("size"))))
    spent = spent.withColumn("_words", words)
    # A row with words is the only one of its source to end where it does.
    one = ["source", "_upto", "_mix", "doc_id", "text_key", "size", "source_size", "target"]
    return (
        spent.groupBy(*one)
        .agg(
            F.sum("_words").alias("taken"),
            F.count(F.when((F.col("size") > 0) & (F.col("_words") == F.col("size")), 1)).alias("readings"),
            (F.count("*") / max_epochs).cast("int").alias("_same"),
        )
        # Rows without words may be alike in all of this.
        .withColumn("_same", F.explode(F.sequence(F.lit(1), F.col("_same"))))
        .select("doc_id", "source", "text_key", "size", "source_size", "target", "readings", "taken")
    )


def mixed_documents(docs: DataFrame, **params) -> DataFrame:
    """The documents, each as often as the mix reads it as a whole; the last reading, if cut, is left out."""
    picks = mix(docs, **params).where("readings > 0")
    one = ["doc_id", "source", "text_key"]
    picks = picks.groupBy(*one).agg(F.sum("readings").alias("readings"))
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "source", F.xxhash64("text").alias("text_key")).alias("d")
    same = F.col("d.text_key") == F.col("p.text_key")
    for name in one[:2]:
        same = same & F.col(f"d.{name}").eqNullSafe(F.col(f"p.{name}"))
    joined = rows.join(picks.alias("p"), same).select("d.*", "p.readings")
    # Repeated rows of a document share one count; the first stands for them.
    first = F.row_number().over(Window.partitionBy(*one).orderBy("doc_id"))
    return (
        joined.withColumn("first", first).where("first = 1")
        .withColumn("reading", F.explode(F.sequence(F.lit(1), F.col("readings").cast("int"))))
        .select(*map(field, docs.columns))
    )
