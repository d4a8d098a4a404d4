"""Date-window filters and elapsed time."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playgauge.functions.exact import as_column

# Partition column that the table writer adds to time-stamped tables.
DAY_COLUMN = "event_day"


def in_period(df: DataFrame, column: str, start: date | Column, end: date | Column) -> DataFrame:
    """Rows whose ``column`` falls on a day from ``start`` to ``end``, both included.

    Catalyst turns the date range on a timestamp into a pushed scan filter.
    Tables laid out by day are also filtered on the partition column, so whole
    folders are skipped.
    """
    kept = df.filter(F.to_date(column).between(start, end))
    if DAY_COLUMN in df.columns:
        kept = kept.filter(F.col(DAY_COLUMN).between(start, end))
    return kept


def seconds_between(start: Column | str, end: Column | str) -> Column:
    return F.timestamp_diff("SECOND", as_column(start), as_column(end))


def attempt_duration() -> Column:
    """Clear time where recorded, else the time from start to end of the attempt."""
    return F.coalesce(F.col("clear_time_sec"), seconds_between("attempt_started_at", "attempt_ended_at"))
