"""Computed columns that the optimizer must not copy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settle(df: DataFrame, columns: list[str]) -> DataFrame:
    """The same rows, with ``columns`` evaluated once at this point.

    Filters are normally pushed below a projection by copying the filtered expression, so a filter on a
    column built from regular expressions runs them twice, and chained columns multiply. Generated columns
    are not pushed through, so a one-element ``inline`` keeps each of them to a single evaluation.
    """
    keep = [c for c in df.columns if c not in columns]
    return df.select(*keep, F.inline(F.array(F.struct(*columns))))
