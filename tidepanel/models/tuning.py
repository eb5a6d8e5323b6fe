"""Grid search over temporal folds and the final check on an untouched fold."""

from __future__ import annotations

import itertools
import time
from collections.abc import Callable, Mapping, Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel import schema as S
from tidepanel.functions.sizing import kept
from tidepanel.models.evaluate import bind, evaluate_model, fold_bits, with_probability
from tidepanel.models.forest import TRAIN, VALID, Forest, score_forests
from tidepanel.operators.metrics import rule_metrics, score_metrics
from tidepanel.operators.time_axis import Fold, split_fold, tuning_rows, tuning_split

# The grid of the forest study.
FOREST_GRID = {"max_depth": [5, 8, 12], "min_samples_leaf": [10, 20], "max_features": ["sqrt", 0.5]}


def candidates(grid: Mapping[str, Sequence]) -> list[dict]:
    """All combinations, the last name varying fastest."""
    names = list(grid)
    return [dict(zip(names, values)) for values in itertools.product(*grid.values())]


def grid_scores(
    df: DataFrame, folds: Sequence[Fold], build: Callable, grid: Mapping[str, Sequence], features: Sequence[str],
    label: str = S.LABEL, parallelism: int = 4,
) -> DataFrame:
    """One row per (candidate, fold) with train accuracy and validation metrics.

    Every fit sees only rows before its validation block.  All candidates read
    one kept table; forests train together, of other models ``parallelism`` fits run at a time.
    """
    built = [build(**s) for s in candidates(grid)]
    if all(isinstance(model, Forest) for model in built):
        return _forest_scores(df, folds, built, features, label)
    columns = list(dict.fromkeys([S.ROW_ID, S.TS, label, *features]))
    rows = df.select(*columns) if df.is_cached else kept(df.select(*columns))
    tasks = [(c, f, s) for c, s in enumerate(candidates(grid)) for f in folds]

    @inheritable_thread_target(df.sparkSession)
    def one(task):
        number, fold, settings = task
        train, valid = split_fold(rows, fold)
        start = time.perf_counter()
        fitted = bind(build(**settings), features, label).fit(train)
        seconds = time.perf_counter() - start
        on_train = rule_metrics(with_probability(fitted.transform(train)), [], label).first()
        on_valid = score_metrics(with_probability(fitted.transform(valid)), [], label).first()
        return (
            number, fold.fold, on_train["accuracy"], on_valid["accuracy"], on_valid["roc_auc"], on_valid["log_loss"], seconds,
        )

    with ThreadPool(max(1, min(parallelism, len(tasks)))) as pool:
        scores = pool.map(one, tasks, chunksize=1)
    if rows.is_cached:
        rows.unpersist()
    return df.sparkSession.createDataFrame(
        scores,
        "candidate int, fold int, train_accuracy double, test_accuracy double, roc_auc double, log_loss double, fit_time double",
    )


def _forest_scores(df: DataFrame, folds: Sequence[Fold], plans: Sequence[Forest], features: Sequence[str], label: str) -> DataFrame:
    """``grid_scores`` of forests: every candidate, fold and tree in the same jobs; fit_time is the tasks' time."""
    scored = kept(score_forests(fold_bits(df, folds), features, label, len(folds), plans).withColumnRenamed("plan", "candidate"))
    keys = ["candidate", "fold"]
    hit = F.when(F.col(S.PREDICTION) == F.col("y"), 1.0).otherwise(0.0)
    trained = F.col("side").bitwiseAND(TRAIN) != 0
    table = scored.groupBy(*keys).agg(F.avg(F.when(trained, hit)).alias("train_accuracy"), F.sum("seconds").alias("fit_time"))
    valid = scored.where(F.col("side").bitwiseAND(VALID) != 0).withColumn(label, F.col("y").cast("int"))
    table = table.join(score_metrics(valid, keys, label).withColumnRenamed("accuracy", "test_accuracy"), keys)
    numbers = F.lit([f.fold for f in folds])
    return table.select(
        "candidate", F.element_at(numbers, F.col("fold")).alias("fold"), "train_accuracy", "test_accuracy", "roc_auc", "log_loss", "fit_time"
    )


def grid_table(scores: DataFrame, grid: Mapping[str, Sequence]) -> DataFrame:
    """Mean scores per candidate with rank 1 = best accuracy (ties share), best first.

    At most as many rows as the grid has combinations.
    """
    settings = candidates(grid)
    names = list(grid)
    listed = scores.sparkSession.createDataFrame(
        [(i, *[str(s[n]) for n in names]) for i, s in enumerate(settings)],
        "candidate int, " + ", ".join(f"param_{n} string" for n in names),
    )
    means = scores.groupBy("candidate").agg(
        F.avg("train_accuracy").alias("mean_train_accuracy"),
        F.avg("test_accuracy").alias("mean_test_accuracy"),
        F.stddev_pop("test_accuracy").alias("std_test_accuracy"),
        F.avg("roc_auc").alias("mean_test_roc_auc"),
        F.avg("log_loss").alias("mean_test_log_loss"),
        F.avg("fit_time").alias("mean_fit_time"),
    )
    best_first = Window.orderBy(F.desc("mean_test_accuracy"))
    return (
        listed.join(means, "candidate")
        .withColumn("rank_test_accuracy", F.rank().over(best_first))
        .orderBy("rank_test_accuracy", "candidate")
    )


def best_settings(table: DataFrame, grid: Mapping[str, Sequence]) -> dict:
    return candidates(grid)[table.orderBy("rank_test_accuracy", "candidate").first()["candidate"]]


def tune_and_check(
    df: DataFrame, folds: Sequence[Fold], build: Callable, grid: Mapping[str, Sequence], features: Sequence[str],
    final: Mapping | None = None, label: str = S.LABEL, parallelism: int = 4,
) -> tuple[DataFrame, DataFrame]:
    """(grid table on all folds but the last, result of the best settings on the last fold).

    ``final`` overrides settings for the refit, for example more trees.
    """
    tuning, holdout = tuning_split(folds)
    scores = grid_scores(tuning_rows(df, folds), tuning, build, grid, features, label, parallelism)
    table = grid_table(scores, grid)
    best = {**best_settings(table, grid), **(final or {})}
    return table, evaluate_model(df, [holdout], build(**best), features, label)
