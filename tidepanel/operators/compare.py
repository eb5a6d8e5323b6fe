"""Fold-wise comparison of two evaluations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel import schema as S

METRICS = ("accuracy", "log_loss", "roc_auc")


def compare_results(a: DataFrame, b: DataFrame, name_a: str = "model_a", name_b: str = "model_b") -> DataFrame:
    """Metrics of both side by side and the deltas b - a, joined on fold."""
    for results, name in ((a, name_a), (b, name_b)):
        S.require_columns(results, ["fold", *METRICS], f"results of {name}")
    left = a.select("fold", *[F.col(m).alias(f"{m}_{name_a}") for m in METRICS])
    right = b.select("fold", *[F.col(m).alias(f"{m}_{name_b}") for m in METRICS])
    deltas = {f"delta_{m}": F.col(f"{m}_{name_b}") - F.col(f"{m}_{name_a}") for m in METRICS}
    return left.join(right, "fold", "inner").withColumns(deltas)


def numeric_means(df: DataFrame, skip: tuple[str, ...] = ("fold",)) -> DataFrame:
    """Mean of every numeric column."""
    names = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in skip]
    return df.agg(*[F.avg(n).alias(n) for n in names])


def folds_ahead(comparison: DataFrame, metric: str = "delta_accuracy") -> DataFrame:
    """Number of folds in which b is better than a."""
    return comparison.agg(F.count_if(F.col(metric) > 0).alias("folds_ahead"), F.count("*").alias("n_folds"))
