"""Restricting an operator to chosen contents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ContentIds = Sequence[int] | DataFrame


def restrict(df: DataFrame, ids: ContentIds | None) -> DataFrame:
    """Rows of the chosen contents; ``ids`` is a list, a frame with content_id, or None for all."""
    if ids is None:
        return df
    if isinstance(ids, DataFrame):
        return df.join(ids.select("content_id").distinct(), "content_id", "left_semi")
    return df.filter(F.col("content_id").isin(list(ids)))
