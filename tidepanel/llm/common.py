"""Helpers that several corpus operators share."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.session import ensure_checkpoint_dir

# Fixed value: a word is a run of characters that are no ASCII white space.
WORD = "[^\\x20\\x09-\\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, _UPPER, _LOWER)


def n_words(text: Column) -> Column:
    """Number of words as BIGINT; NULL counts as an empty text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below the one that driver and executors share (``spark.checkpoint.dir``)."""
    ensure_checkpoint_dir(spark)
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, *by: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder, in folders ``by`` value, and read back: lineage ends there.

    A lost executor cannot lose the rows, and later jobs start from the files.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_HELD: dict = {}


def of_stage(key, make):
    """``make()``, kept in this worker for the other tasks of the stage; what an earlier stage kept is dropped first."""
    task = TaskContext.get()
    stage = task.stageId() if task else None
    if _HELD.get("stage") != stage:
        _HELD.clear()
        pa.default_memory_pool().release_unused()
        _HELD["stage"] = stage
    if key not in _HELD:
        _HELD[key] = make()
    return _HELD[key]
