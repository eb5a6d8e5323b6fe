"""Evaluation of learned models on temporal folds."""

from __future__ import annotations

from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel import schema as S
from tidepanel.functions.sizing import kept, pass_tasks
from tidepanel.models.boosting import BoostedModel, Boosting, fit_folds, score_folds
from tidepanel.models.builders import FeatureModel, LogisticModel
from tidepanel.models.forest import VALID, Forest, score_forests
from tidepanel.models.linear import fit_logits, packed_rows, score_logits
from tidepanel.operators.baselines import fold_rates
from tidepanel.operators.metrics import score_metrics
from tidepanel.operators.time_axis import Fold, check_fold_list, fold_table, split_fold

RESULT_COLUMNS = (
    "fold", "train_start", "train_end", "valid_start", "valid_end", "train_positive_rate", "valid_positive_rate",
    "accuracy", "log_loss", "roc_auc", "n_valid_predictions", "n_correct_predictions",
)


def bind(model, features: Sequence[str], label: str) -> Estimator:
    """A Spark ML estimator of its own, copied, or one of our factories bound to features."""
    if isinstance(model, FeatureModel):
        return model.on(features, label)
    if isinstance(model, Estimator):
        return model.copy()
    raise TypeError(f"not a model: {model!r}")


def with_probability(scored: DataFrame) -> DataFrame:
    """Positive-class probability ``p1`` and an integer ``prediction``."""
    if S.PROBABILITY not in scored.columns:
        scored = scored.withColumn(S.PROBABILITY, vector_to_array("probability")[1])
    return scored.withColumn(S.PREDICTION, F.col(S.PREDICTION).cast("int"))


def fold_bits(df: DataFrame, folds: Sequence[Fold]) -> DataFrame:
    """Columns ``train`` and ``valid``: bit f is set when the row is on that side of fold f."""
    def bits(start: str, end: str):
        total = F.lit(0)
        for position, fold in enumerate(folds):
            inside = F.col(S.TS).between(getattr(fold, start), getattr(fold, end))
            total = total + F.when(inside, 1 << position).otherwise(0)
        return total

    return df.withColumns({"train": bits("train_start", "train_end"), "valid": bits("valid_start", "valid_end")})


def scored_folds(
    df: DataFrame, folds: Sequence[Fold], model, features: Sequence[str], label: str = S.LABEL, parallelism: int = 4
) -> DataFrame:
    """Validation rows of all folds: (ROW_ID, fold, label, prediction, p1); ``fold`` counts from 1.

    Boosted models, forests and logistic regressions train all folds in the same passes.  Other models are fitted
    per fold on rows filtered by date from one kept table, a few folds at a time;
    each gets a fresh copy of the model, so nothing leaks between folds.
    """
    folds = check_fold_list(folds)
    S.require_columns(df, [S.TS, S.ROW_ID, label, *features], "model evaluation")
    if isinstance(model, Boosting):
        models, rows = fit_folds(fold_bits(df, folds), features, label, len(folds), model)
        return score_folds(rows, models).select(
            S.ROW_ID, "fold", F.col("y").cast("int").alias(label), S.PREDICTION, S.PROBABILITY
        )
    if isinstance(model, Forest):
        scored = score_forests(fold_bits(df, folds), features, label, len(folds), [model])
        valid = scored.where(F.col("side").bitwiseAND(VALID) != 0)
        return valid.select(S.ROW_ID, "fold", F.col("y").cast("int").alias(label), S.PREDICTION, S.PROBABILITY)
    if isinstance(model, LogisticModel):
        return logistic_sets(df, folds, model, [features], label).drop("set")
    columns = list(dict.fromkeys([S.ROW_ID, S.TS, label, *features]))
    # short rows in equal shares, as many as their number asks for: a fit runs many short jobs
    narrow = df.select(*columns)
    tasks = pass_tasks(df.sparkSession, narrow.count(), 8 * len(columns))
    rows = kept(narrow.repartition(tasks, S.ROW_ID))

    @inheritable_thread_target(df.sparkSession)
    def one(item):
        position, fold = item
        train, valid = split_fold(rows, fold)
        fitted = bind(model, features, label).fit(train)
        scored = with_probability(fitted.transform(valid))
        return scored.select(S.ROW_ID, F.lit(position).alias("fold"), label, S.PREDICTION, S.PROBABILITY)

    with ThreadPool(min(parallelism, len(folds))) as pool:
        parts = pool.map(one, list(enumerate(folds, start=1)))
    everything = parts[0]
    for part in parts[1:]:
        everything = everything.unionByName(part)
    return everything


def logistic_sets(df: DataFrame, folds: Sequence[Fold], model: LogisticModel, sets: Sequence[Sequence[str]], label: str = S.LABEL) -> DataFrame:
    """Validation rows of all folds under every feature set: (set, ROW_ID, fold, label, prediction, p1); sets count from 0."""
    columns = list(dict.fromkeys(c for names in sets for c in names))
    rows = packed_rows(fold_bits(df, folds), columns, label)
    problems = fit_logits(rows, len(columns), len(folds), [[columns.index(c) for c in names] for names in sets], model.C, model.max_iter)
    scored = score_logits(rows, len(columns), problems)
    return scored.select("set", S.ROW_ID, "fold", F.col("y").cast("int").alias(label), S.PREDICTION, S.PROBABILITY)


def evaluate_model(
    df: DataFrame, folds: Sequence[Fold], model, features: Sequence[str], label: str = S.LABEL, parallelism: int = 4
) -> DataFrame:
    """One row per fold: bounds, class rates, accuracy, log-loss, ROC-AUC and counts."""
    folds = check_fold_list(folds)
    S.require_columns(df, [S.TS, S.ROW_ID, label, *features], "model evaluation")
    numbered = [f._replace(fold=i) for i, f in enumerate(folds, start=1)]
    rates = fold_rates(df, numbered, label).collect()  # k rows
    whole = {r["fold"] for r in rates if None not in tuple(r)}
    for fold in numbered:
        if fold.fold not in whole:
            raise ValueError(f"fold {fold.fold} has no train or no validation rows")
    scored = scored_folds(df, folds, model, features, label, parallelism)
    valid_only = F.when(F.col(S.PREDICTION).isin(0, 1), F.col(S.PREDICTION)).otherwise(
        F.raise_error(F.lit("predictions must be 0 or 1")).cast("int")
    )
    metrics = score_metrics(scored.withColumn(S.PREDICTION, valid_only), ["fold"], label)
    spark = df.sparkSession
    known = spark.createDataFrame(
        [tuple(r) for r in rates], "fold int, train_positive_rate double, valid_positive_rate double"
    )
    table = fold_table(spark, numbered).join(known, "fold").join(metrics, "fold")
    return table.select(*RESULT_COLUMNS)


def importances(models: Sequence[BoostedModel], spark) -> DataFrame:
    """(fold, feature, gain) of boosted models; folds x features rows."""
    rows = [(i, name, gain) for i, m in enumerate(models, start=1) for name, gain in m.importances().items()]
    return spark.createDataFrame(rows, "fold int, feature string, gain double")


def top_features(table: DataFrame, n: int = 20) -> DataFrame:
    """Features with the highest mean gain over the folds, ties by name."""
    return (
        table.groupBy("feature").agg(F.avg("gain").alias("mean_gain")).orderBy(F.desc("mean_gain"), "feature").limit(n)
    )
