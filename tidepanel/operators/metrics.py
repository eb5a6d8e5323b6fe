"""Accuracy, log-loss and tie-aware ROC-AUC as aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel import schema as S

# Fixed value: the probability clip of the log-loss (double precision epsilon).
CLIP = 2.220446049250313e-16
SCORE_BINS = 65_536


def log_loss_term(label: Column, p: Column) -> Column:
    """Loss of one row; only the branch of the true class is evaluated."""
    p = F.least(F.greatest(p, F.lit(CLIP)), F.lit(1.0 - CLIP))
    return -F.when(label == 1, F.ln(p)).otherwise(F.ln(F.lit(1.0) - p))


def rule_metrics(predicted: DataFrame, by: Sequence[str] = ("fold",), label: str = S.LABEL) -> DataFrame:
    """Accuracy and counts of hard predictions."""
    hit = F.col(label) == F.col(S.PREDICTION)
    return predicted.groupBy(*by).agg(
        F.avg(hit.cast("int")).alias("accuracy"),
        F.count("*").alias("n_valid_predictions"),
        F.count_if(hit).alias("n_correct_predictions"),
    )


def score_metrics(
    scored: DataFrame,
    by: Sequence[str] = ("fold",),
    label: str = S.LABEL,
    score: str = S.PROBABILITY,
    bins: int = SCORE_BINS,
) -> DataFrame:
    """Accuracy, log-loss, ROC-AUC and counts per group, exact at any size.

    Rows collapse to distinct scores before the shuffle.  The running count that
    the AUC needs is cut into ``bins`` score intervals per group, so that one
    group, however large, is spread over many tasks; the totals of the intervals
    are then chained in a table of at most ``bins`` + 1 rows per group.  Ties
    count one half.  ``roc_auc`` is NULL when a group has a single class.
    """
    by = list(by)
    S.require_columns(scored, [*by, label, score, S.PREDICTION], "scored rows")
    y = F.col(label)
    # monotone in the score, so the intervals are ordered like the scores
    interval = F.floor(F.least(F.greatest(F.col("__s"), F.lit(0.0)), F.lit(1.0)) * bins).cast("int")
    distinct = (
        scored.select(*by, y.alias("__y"), F.col(score).alias("__s"), F.col(S.PREDICTION).alias("__p"))
        .groupBy(*by, "__s")
        .agg(
            F.count_if(F.col("__y") == 1).alias("pos"),
            F.count_if(F.col("__y") != 1).alias("neg"),
            F.count_if(F.col("__y") == F.col("__p")).alias("hit"),
        )
        .withColumn("__bin", interval)
    )
    inside = Window.partitionBy(*by, "__bin").orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    ranked = distinct.withColumn("below", F.coalesce(F.sum("neg").over(inside), F.lit(0)))
    s = F.col("__s")
    loss = F.col("pos") * log_loss_term(F.lit(1), s) + F.col("neg") * log_loss_term(F.lit(0), s)
    wins = F.col("pos").cast("double") * (F.col("below") + F.col("neg") / F.lit(2.0))
    intervals = ranked.groupBy(*by, "__bin").agg(
        F.sum("pos").alias("pos"),
        F.sum("neg").alias("neg"),
        F.sum("hit").alias("hit"),
        F.sum(loss).alias("loss"),
        F.sum(wins).alias("wins"),
    )
    chain = Window.partitionBy(*by).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    chained = intervals.withColumn("lower", F.coalesce(F.sum("neg").over(chain), F.lit(0)))
    total = F.sum("pos") + F.sum("neg")
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return chained.groupBy(*by).agg(
        (F.sum("hit") / total).alias("accuracy"),
        (F.sum("loss") / total).alias("log_loss"),
        F.try_divide(F.sum(F.col("wins") + F.col("pos").cast("double") * F.col("lower")), pairs).alias("roc_auc"),
        total.alias("n_valid_predictions"),
        F.sum("hit").alias("n_correct_predictions"),
    )


def class_rates(df: DataFrame, by: Sequence[str], label: str = S.LABEL) -> DataFrame:
    """Share of class 1 per group."""
    return df.groupBy(*by).agg(F.avg(F.col(label)).alias("positive_rate"), F.count("*").alias("n_rows"))


def sign_accuracy(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ("fold",)) -> DataFrame:
    """Share of rows where actual and predicted value are on the same side of 0."""
    same = (F.coalesce(F.col(actual), F.lit(0.0)) > 0) == (F.coalesce(F.col(predicted), F.lit(0.0)) > 0)
    return df.groupBy(*by).agg(F.avg(same.cast("int")).alias("accuracy"), F.count("*").alias("n"))


def cv_band(scores: DataFrame, metric: str = "accuracy") -> DataFrame:
    """Mean and population deviation of fold scores in percent, with the band around the mean."""
    return scores.agg(
        (F.avg(metric) * 100).alias("mean_pct"), (F.stddev_pop(metric) * 100).alias("std_pct")
    ).withColumns(
        {"lower_pct": F.col("mean_pct") - F.col("std_pct"), "upper_pct": F.col("mean_pct") + F.col("std_pct")}
    )
