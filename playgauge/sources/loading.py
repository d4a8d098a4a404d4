"""Loading text rows in one pass: typed rows, quarantined rows, and counts of both with their reasons.

A text row is judged once. One job writes it to the folder of accepted rows, typed, or to that of quarantined
ones, with its text fields and reasons, and counts outcomes and reasons on the way (an ``Observation``); nothing is
read twice, and no row is left out without a trace.

Empty input gives empty folders' tables and zero counts. NULL lines are malformed rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from playgauge.sources.reader import MALFORMED, reasons_of, text_rows, typed_columns
from playgauge.sources.schemas import TABLES, Table

OUTCOME = "outcome"
ACCEPTED, QUARANTINED = "accepted", "quarantined"


@dataclass(frozen=True)
class Loaded:
    """Both folders' rows, and how many rows had each outcome and each reason."""

    accepted: DataFrame
    quarantined: DataFrame
    counts: dict[str, int]


def parse_lines(
    lines: DataFrame, table: Table, file_columns: Sequence[str] | None = None, escape: str = '"', column: str = "value"
) -> DataFrame:
    """Fields of a column of comma-separated lines, as text, with the line itself where it is malformed.

    Works on any lines, whether from files or a stream of messages. Further columns of ``lines`` are dropped.
    """
    order = list(file_columns or table.names)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*order, MALFORMED]])
    options = {"sep": ",", "quote": '"', "escape": escape, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": MALFORMED}
    # A NULL line is no record; an empty one has too few fields.
    fields = F.from_csv(F.coalesce(F.col(column), F.lit("")), schema.simpleString(), options)
    return lines.select(fields.alias("f")).select("f.*")


def judged(raw: DataFrame, table: Table) -> DataFrame:
    """One row per text row: ``outcome``, ``reasons``, the typed columns (NULL if quarantined) and the text fields."""
    rows = raw.select(F.struct(*table.names, MALFORMED).alias("fields"), reasons_of(table).alias("reasons"), *raw.columns)
    good = F.size("reasons") == 0
    return rows.select(
        F.when(good, ACCEPTED).otherwise(QUARANTINED).alias(OUTCOME),
        F.when(~good, F.col("reasons")).alias("reasons"),
        F.when(~good, F.col("fields")).alias("fields"),
        F.when(good, F.struct(*typed_columns(table))).alias("row"),
    )


def outcome_counts(rows: DataFrame, table: Table) -> DataFrame:
    """Judged rows counted: table_name, outcome (or reason; a row may have several) and rows."""
    labels = F.concat(F.array(OUTCOME), F.coalesce("reasons", F.array().cast("array<string>")))
    return (
        rows.select(F.explode(labels).alias(OUTCOME))
        .groupBy(F.lit(table.name).alias("table_name"), OUTCOME)
        .agg(F.count("*").alias("rows"))
    )


def reason_names(table: Table) -> list[str]:
    """Every reason that a row of the table can be quarantined for."""
    names = ["malformed_row"]
    for column in table.columns:
        if column.kind == "text":
            names += [f"too_long:{column.name}"] if column.max_length is not None else []
        else:
            names += [f"bad_value:{column.name}"] + ([f"missing:{column.name}"] if column.required else [])
    return names


def load(rows: DataFrame, table: Table, folder: str, mode: str = "errorifexists") -> Loaded:
    """Write judged rows below ``folder``, one folder per outcome, and count them in the same pass."""
    spark, seen = rows.sparkSession, Observation(f"load {table.name}")
    flags = [F.count_if(F.array_contains("reasons", name)).alias(name) for name in reason_names(table)]
    outcomes = [F.count_if(F.col(OUTCOME) == name).alias(name) for name in (ACCEPTED, QUARANTINED)]
    rows.observe(seen, *outcomes, *flags).write.mode(mode).partitionBy(OUTCOME).parquet(folder)
    written = spark.read.schema(rows.schema).parquet(folder)
    accepted = written.filter(F.col(OUTCOME) == ACCEPTED).select("row.*")
    quarantined = written.filter(F.col(OUTCOME) == QUARANTINED).select("fields.*", "reasons")
    counts = {name: n for name, n in seen.get.items() if n or name in (ACCEPTED, QUARANTINED)}
    return Loaded(accepted, quarantined, counts)


def load_csv(
    spark: SparkSession, name: str, path: str | Sequence[str], folder: str, mode: str = "errorifexists", **options
) -> Loaded:
    """Load a declared table's CSV files; ``options`` as for ``read_csv``."""
    table = TABLES[name]
    return load(judged(text_rows(spark, table, path, **options), table), table, folder, mode)
