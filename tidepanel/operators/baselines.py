"""Rule baselines on temporal folds: one pass over the panel for all rules and folds."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel import schema as S
from tidepanel.functions.rules import MAJORITY, RULES, rule_columns, rule_inputs
from tidepanel.operators.metrics import rule_metrics
from tidepanel.operators.time_axis import (
    FOLD_KEYS,
    TRAIN,
    VALID,
    Fold,
    check_fold_list,
    expanding_roles,
    explode_roles,
    fold_table,
    number_dates,
    split_fold,
)


def baseline_names() -> list[str]:
    return [MAJORITY, *RULES]


def evaluate_rules(
    df: DataFrame,
    folds: Sequence[Fold] | None = None,
    rules: Mapping[str, Column] | Sequence[str] | None = None,
    size: int = S.FOLD_SIZE,
    k: int = S.FOLD_COUNT,
) -> DataFrame:
    """One row per (strategy, fold) with bounds, class rates, accuracy and counts.

    The panel is reduced to counts per date first (partial aggregation, at most
    10,000 rows shuffled per task).  Folds, the majority class and all metrics
    come from that table, so neither overlapping train periods nor the number of
    rules multiply panel rows.  Without ``folds`` the expanding-window folds
    (``size``, ``k``) are laid over the dates found in the same pass.
    ``majority`` predicts the more frequent class of the fold's train rows,
    class 1 on a tie.
    """
    S.require_columns(df, [S.TS, S.LABEL, S.ROW_ID], "rule evaluation")
    if rules is None:
        rules = baseline_names()
    if not isinstance(rules, Mapping):
        known = rule_columns()
        for name in rules:
            S.require_columns(df, rule_inputs(name), f"rule {name}")
        rules = {name: known.get(name) for name in rules}
    untrained = {name: c for name, c in rules.items() if name != MAJORITY}

    label = F.col(S.LABEL)
    invalid = lambda c: F.raise_error(F.lit("predictions must be 0 or 1")).cast("int")
    hits = []
    for i, rule in enumerate(untrained.values()):
        checked = F.when(rule.isin(0, 1), rule).otherwise(invalid(rule))
        hits.append(F.count_if(checked == label).alias(f"hit_{i}"))
    per_date = df.groupBy(S.TS).agg(
        F.count("*").alias("n"), F.sum((label == 1).cast("long")).alias("n_pos"), *hits
    )
    if folds is None:
        axis = number_dates(per_date)
        roles = expanding_roles(axis, size, k)
        bounds = None
    else:
        folds = check_fold_list(folds)
        roles = explode_roles(per_date, folds)
        bounds = fold_table(df.sparkSession, folds)

    train, valid = F.col("side") == TRAIN, F.col("side") == VALID

    def over(condition: Column, column: str) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col(column))), F.lit(0))

    per_fold = roles.groupBy("fold").agg(
        over(train, "n").alias("n_train"),
        over(train, "n_pos").alias("pos_train"),
        over(valid, "n").alias("n_valid"),
        over(valid, "n_pos").alias("pos_valid"),
        *[over(valid, f"hit_{i}").alias(f"hit_{i}") for i in range(len(untrained))],
        # bounds of the dates that the fold found, so that no second pass is needed
        F.min(F.when(train, F.col(S.TS))).alias("train_start"),
        F.max(F.when(train, F.col(S.TS))).alias("train_end"),
        F.min(F.when(valid, F.col(S.TS))).alias("valid_start"),
        F.max(F.when(valid, F.col(S.TS))).alias("valid_end"),
    )
    if bounds is not None:
        per_fold = per_fold.drop(*FOLD_KEYS[1:]).join(F.broadcast(bounds), "fold")  # k rows
    empty = (F.col("n_train") == 0) | (F.col("n_valid") == 0)
    refuse = F.raise_error(F.lit("a fold has no train or no validation rows")).cast("long")
    per_fold = per_fold.withColumn("n_valid", F.when(empty, refuse).otherwise(F.col("n_valid")))
    majority_hits = F.when(
        F.col("pos_train") * 2 >= F.col("n_train"), F.col("pos_valid")
    ).otherwise(F.col("n_valid") - F.col("pos_valid"))
    position = {name: i for i, name in enumerate(untrained)}
    long = F.array(
        *[
            F.struct(
                F.lit(name).alias("strategy"),
                (majority_hits if name == MAJORITY else F.col(f"hit_{position[name]}")).alias("hit"),
            )
            for name in rules
        ]
    )
    return per_fold.withColumn("s", F.explode(long)).select(
        F.col("s.strategy").alias("strategy"),
        "fold",
        "train_start",
        "train_end",
        "valid_start",
        "valid_end",
        (F.col("pos_train") / F.col("n_train")).alias("train_positive_rate"),
        (F.col("pos_valid") / F.col("n_valid")).alias("valid_positive_rate"),
        (F.col("s.hit") / F.col("n_valid")).alias("accuracy"),
        F.col("n_valid").alias("n_valid_predictions"),
        F.col("s.hit").alias("n_correct_predictions"),
    )


def fold_rates(df: DataFrame, folds: Sequence[Fold], label: str = S.LABEL) -> DataFrame:
    """(fold, train_positive_rate, valid_positive_rate), reduced per date first."""
    per_date = df.groupBy(S.TS).agg(F.count("*").alias("n"), F.sum((F.col(label) == 1).cast("long")).alias("n_pos"))
    roles = explode_roles(per_date, folds)

    def rate(side: str) -> Column:
        here = F.col("side") == side
        return F.try_divide(F.sum(F.when(here, F.col("n_pos"))), F.sum(F.when(here, F.col("n"))))

    return roles.groupBy("fold").agg(
        rate(TRAIN).alias("train_positive_rate"), rate(VALID).alias("valid_positive_rate")
    )


def evaluate_custom(
    df: DataFrame, folds: Sequence[Fold], predict: Callable[[DataFrame, DataFrame], DataFrame]
) -> DataFrame:
    """The same for a user function (train rows, validation rows) -> rows with ``prediction``.

    Column rules are cheaper; this hook is for rules that need to see both frames.
    """
    from tidepanel.operators.quality import check_predictions

    S.require_columns(df, [S.TS, S.LABEL, S.ROW_ID], "rule evaluation")
    folds = check_fold_list(folds)
    parts = []
    for fold in folds:
        train, valid = split_fold(df, fold)
        predicted = predict(train, valid)
        check_predictions(predicted, valid)
        parts.append(predicted.select(F.lit(fold.fold).alias("fold"), S.LABEL, S.PREDICTION))
    everything = parts[0]
    for part in parts[1:]:
        everything = everything.unionByName(part)
    table = fold_table(df.sparkSession, folds)
    return table.join(fold_rates(df, folds), "fold").join(rule_metrics(everything), "fold")


def strategy_table(results: DataFrame, strategies: Sequence[str] | None = None) -> DataFrame:
    """Accuracy per fold, one column per strategy."""
    names = list(strategies) if strategies else baseline_names()
    return results.groupBy("fold").pivot("strategy", names).agg(F.first("accuracy"))


def strategy_summary(results: DataFrame) -> DataFrame:
    """Mean, sample deviation, minimum and maximum accuracy over the folds."""
    return results.groupBy("strategy").agg(
        F.avg("accuracy").alias("mean_accuracy"),
        F.stddev_samp("accuracy").alias("std_accuracy"),
        F.min("accuracy").alias("min_accuracy"),
        F.max("accuracy").alias("max_accuracy"),
    )
