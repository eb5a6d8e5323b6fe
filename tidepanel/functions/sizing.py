"""Caching and partitioning of tables that several jobs read."""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

PART_BYTES = 1 << 25  # rows of one task of a pass that is repeated many times
PART_ROWS = 4096  # fewer rows than this are not worth a task of their own


def kept(df: DataFrame) -> DataFrame:
    """``df`` itself when it is cached already, else marked for caching (memory, then disk).

    For tables that several jobs read.  Lost blocks are computed again; callers
    release them with ``unpersist`` or ``spark.catalog.clearCache()``.
    """
    return df if df.is_cached else df.persist(StorageLevel.MEMORY_AND_DISK)


def pass_tasks(spark: SparkSession, rows: int, row_bytes: int) -> int:
    """Number of partitions of a kept table that hundreds of short jobs read.

    It follows from the table's size, not from ``spark.sql.shuffle.partitions``, which suits the size of the base tables: every
    task costs its start in every job.  Small tables get one task per core while a task has ``PART_ROWS`` rows.
    """
    cores = spark.sparkContext.defaultParallelism
    return max(1, math.ceil(rows * row_bytes / PART_BYTES), min(cores, math.ceil(rows / PART_ROWS)))
