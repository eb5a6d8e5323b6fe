"""Attaching the binary label to the feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidepanel import schema as S
from tidepanel.functions.rules import class_of


def with_class(labels: DataFrame) -> DataFrame:
    """Label table plus ``class``."""
    S.require_columns(labels, [S.TARGET], "labels")
    return labels.withColumn(S.LABEL, class_of(S.TARGET))


def join_labels(features: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(features with target and class, labels with class); inner join on ROW_ID."""
    S.require_columns(features, [S.ROW_ID], "features")
    S.require_columns(labels, [S.ROW_ID, S.TARGET], "labels")
    labelled = with_class(labels)
    return features.join(labelled, S.ROW_ID, "inner"), labelled


def split_target(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(features without target, ROW_ID and target)."""
    return df.drop(S.TARGET), df.select(S.ROW_ID, S.TARGET)
