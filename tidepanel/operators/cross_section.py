"""Cross-sectional means: the mean over all entities of one date, put on each row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel import schema as S
from tidepanel.functions.features import AVERAGE_PERF, STD_PERF, with_performance
from tidepanel.operators.per_date import join_per_date


def with_date_means(df: DataFrame, columns: Sequence[str], prefix: str = "ALLOCATIONS_", bounded: bool = True) -> DataFrame:
    """Add ``<prefix><column>`` for every column.

    Partial sums per date, then a join on the short date table: unlike a window
    over TS this never shuffles or sorts the wide rows, whatever one date holds.
    """
    means = df.groupBy(S.TS).agg(*[F.avg(c).alias(f"{prefix}{c}") for c in columns])
    return join_per_date(df, means, "left", bounded)


def with_cross_section(df: DataFrame, bounded: bool = True) -> DataFrame:
    """Performance columns and their means over the date."""
    return with_date_means(with_performance(df), AVERAGE_PERF + STD_PERF, bounded=bounded)
