"""Loading declared tables from CSV text or Parquet."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from playgauge.sources.schemas import TABLES, Col, Table

MALFORMED = "_malformed"


@dataclass(frozen=True)
class CheckedLoad:
    """Typed rows that meet the declaration, and the raw rows that do not."""

    accepted: DataFrame
    rejected: DataFrame


def read_csv(
    spark: SparkSession,
    name: str,
    path: str | Sequence[str],
    file_columns: Sequence[str] | None = None,
    escape: str = '"',
    multiline: bool = False,
    rejected: str = "split",
) -> CheckedLoad:
    """Load comma-separated UTF-8 text with a header line against a declared table.

    Fields are taken by position; ``file_columns`` gives their order where the
    file differs from the declaration. A file whose header line names other columns,
    or these in another order, makes the read fail. Every field is read as text and then
    converted, so one bad field rejects its row with a reason instead of
    failing the load or turning into a wrong value. Empty optional fields become
    NULL. ``multiline`` allows line breaks inside quotes, at the price of one
    task per file; leave it off for large files. With ``rejected="fail"`` reading the
    accepted rows fails at the first rejected one.
    """
    table = TABLES[name]
    return check_rows(text_rows(spark, table, path, file_columns, escape, multiline), table, rejected)


def text_rows(
    spark: SparkSession,
    table: Table,
    path: str | Sequence[str],
    file_columns: Sequence[str] | None = None,
    escape: str = '"',
    multiline: bool = False,
) -> DataFrame:
    """A declared table's CSV files as rows of text fields, with the line of a malformed row."""
    order = list(file_columns or table.names)
    if sorted(order) != sorted(table.names):
        raise ValueError(f"file_columns must name exactly the columns of {table.name}")
    raw_schema = T.StructType([T.StructField(c, T.StringType()) for c in [*order, MALFORMED]])
    return (
        spark.read.schema(raw_schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("sep", ",")
        .option("quote", '"')
        .option("escape", escape)
        .option("encoding", "UTF-8")
        .option("multiLine", multiline)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", MALFORMED)
        .csv(path)
    )


def check_rows(raw: DataFrame, table: Table, rejected: str = "split") -> CheckedLoad:
    """Split rows of text fields into typed accepted rows and rejected rows, or fail on reading past one."""
    judged = raw.withColumn("reasons", reasons_of(table))
    good = F.size("reasons") == 0
    if rejected == "fail":
        reason = F.concat(F.lit(f"{table.name}: rejected row: "), F.array_join("reasons", ", "))
        good = F.when(good, F.lit(True)).otherwise(F.raise_error(reason).cast("boolean"))
    accepted = judged.filter(good).select(*typed_columns(table))
    bad = judged.filter(F.size("reasons") > 0).select(*table.names, MALFORMED, "reasons")
    return CheckedLoad(accepted, bad)


def reasons_of(table: Table) -> Column:
    """Why a row of text fields doesn't meet the declaration; empty if it does."""
    checks = [F.when(F.col(MALFORMED).isNotNull(), F.lit("malformed_row"))]
    for column in table.columns:
        checks.extend(_checks(column))
    return F.array_compact(F.array(*checks))


def typed_columns(table: Table) -> list[Column]:
    """The declared columns, converted from text fields."""
    return [_typed(column).alias(column.name) for column in table.columns]


def _text_of(column: Col) -> Column:
    field = F.col(column.name)
    if column.required and column.kind == "text":
        return F.coalesce(field, F.lit(""))
    return F.nullif(field, F.lit(""))


def _typed(column: Col) -> Column:
    if column.kind == "text":
        return _text_of(column)
    return _text_of(column).try_cast(column.data_type)


def _checks(column: Col) -> list[Column]:
    checks = []
    if column.kind != "text":
        unreadable = _text_of(column).isNotNull() & _typed(column).isNull()
        checks.append(F.when(unreadable, F.lit(f"bad_value:{column.name}")))
        if column.required:
            checks.append(F.when(_text_of(column).isNull(), F.lit(f"missing:{column.name}")))
    elif column.max_length is not None:
        too_long = F.char_length(_text_of(column)) > column.max_length
        checks.append(F.when(too_long, F.lit(f"too_long:{column.name}")))
    return checks


def with_collation(df: DataFrame, collation: str = "UNICODE_CI_AI") -> DataFrame:
    """The same table with text columns that compare, join and group by ``collation``.

    ``UNICODE_CI_AI`` ignores case and accents; ``UTF8_LCASE`` ignores case and is cheaper.
    """
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({name: F.collate(name, collation) for name in texts})


def load_report(name: str, load: CheckedLoad) -> DataFrame:
    """Rows per outcome of a load: ``accepted``, ``rejected``, and each reason (a row may have several)."""
    bad = load.rejected.select(F.lit("rejected").alias("outcome"), "reasons")
    bad = bad.withColumn("outcome", F.explode(F.concat(F.array("outcome"), "reasons"))).select("outcome")
    return (
        load.accepted.select(F.lit("accepted").alias("outcome"))
        .unionByName(bad)
        .groupBy(F.lit(name).alias("table_name"), "outcome")
        .agg(F.count("*").alias("rows"))
    )


def schema_report(df: DataFrame, table: Table) -> dict[str, list[str]]:
    """Columns that differ from the declaration: ``missing``, ``extra``, and of another ``type``."""
    found = {f.name: f.dataType for f in df.schema.fields}
    return {
        "missing": [c.name for c in table.columns if c.name not in found],
        "extra": [name for name in found if name not in table.names],
        "type": [
            f"{c.name}: {found[c.name].simpleString()}, declared {c.data_type.simpleString()}"
            for c in table.columns
            if c.name in found and found[c.name] != c.data_type
        ],
    }


def read_table(
    spark: SparkSession,
    name: str,
    path: str,
    fmt: str = "parquet",
    collation: str | None = None,
    rejected: str = "fail",
) -> DataFrame:
    """Rows of one declared table.

    CSV rows that don't meet the declaration make the reading job fail with their reason; ``rejected="drop"``
    leaves them out. ``read_csv`` gives them beside the accepted ones, and ``load_report`` counts them. Parquet
    with columns missing or of another type is refused; further columns, like a day's, are kept.
    """
    if rejected not in ("fail", "drop"):
        raise ValueError(f"unknown treatment of rejected rows {rejected!r}")
    if fmt == "csv":
        df = read_csv(spark, name, path, rejected=rejected).accepted
    elif fmt == "parquet":
        df = spark.read.parquet(path)
        report = schema_report(df, TABLES[name])
        if report["missing"] or report["type"]:
            raise ValueError(f"{name}: missing {report['missing']}, of another type {report['type']}")
    else:
        raise ValueError(f"unknown format {fmt!r}")
    return df if collation is None else with_collation(df, collation)


def read_tables(
    spark: SparkSession, root: str, fmt: str = "parquet", collation: str | None = None, rejected: str = "fail"
) -> dict[str, DataFrame]:
    """All declared tables below one folder, named after the tables."""
    suffix = ".csv" if fmt == "csv" else ""
    return {name: read_table(spark, name, f"{root}/{name}{suffix}", fmt, collation, rejected) for name in TABLES}
