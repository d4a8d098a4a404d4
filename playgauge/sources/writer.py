"""Writing loaded tables and result tables."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playgauge.functions.period import DAY_COLUMN, in_period
from playgauge.sources.schemas import TABLES


#: Tables with a time of creation that are looked up by key, not by day.
DIMENSIONS = ("accounts", "characters")


def _by_day(df: DataFrame, time_column: str) -> DataFrame:
    """The rows with their day, dealt so that a large day is several tasks and small days are one."""
    return df.withColumn(DAY_COLUMN, F.to_date(time_column)).hint("rebalance", DAY_COLUMN)


def write_days(df: DataFrame, name: str, path: str) -> None:
    """Replace the days that ``df`` has rows of in a stored fact; other days stay as they are.

    Loading a day again thus leaves one copy of it. Each day is written in few, large files. A job that dies before
    its end leaves every day as it was; days are then put in place one by one, so a day is old or new as a whole on
    stores that rename folders at once.
    """
    time_column = TABLES[name].time_column
    if time_column is None or name in DIMENSIONS:
        raise ValueError(f"{name} has no days")
    rows = _by_day(df.drop(DAY_COLUMN), time_column)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY_COLUMN).parquet(path)


def compact_days(spark: SparkSession, name: str, path: str, start: date, end: date) -> None:
    """Rewrite a stored fact's days from ``start`` to ``end`` in few files, as after many small loads."""
    write_days(in_period(spark.read.parquet(path), TABLES[name].time_column, start, end), name, path)


def write_table(df: DataFrame, name: str, path: str, mode: str = "errorifexists") -> None:
    """Write a declared table as Parquet, time-stamped facts in folders by day.

    The rebalance hint lets adaptive execution split a day that holds far more
    rows than others over several tasks and merge small ones.
    """
    time_column = TABLES[name].time_column
    if time_column is None or name in DIMENSIONS:
        df.write.mode(mode).parquet(path)
        return
    _by_day(df, time_column).write.mode(mode).partitionBy(DAY_COLUMN).parquet(path)


def write_bucketed(df: DataFrame, table_name: str, key: str, buckets: int, mode: str = "errorifexists") -> None:
    """Save a catalog table bucketed and sorted by ``key``.

    Attempts, rewards and pattern logs bucketed alike on the attempt id join
    without a shuffle.
    """
    df.write.mode(mode).bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(table_name)


def write_result(
    df: DataFrame,
    path: str,
    headers: Mapping[str, str] | None = None,
    mode: str = "errorifexists",
) -> None:
    """Export a result as CSV text with a header and the word NULL for NULL."""
    if headers:
        df = df.withColumnsRenamed(dict(headers))
    (
        df.write.mode(mode)
        .option("header", True)
        .option("encoding", "UTF-8")
        .option("nullValue", "NULL")
        .csv(path)
    )
