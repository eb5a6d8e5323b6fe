"""The named queries of this library over a data folder; see ``oracle.py`` for their SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel import schema as S
from tidepanel.functions import features as X
from tidepanel.functions.rules import class_of, rule_score, with_rule
from tidepanel.functions.sizing import kept
from tidepanel.models import builders, evaluate, linear
from tidepanel.models.boosting import fit_folds
from tidepanel.models.tuning import FOREST_GRID, grid_scores, grid_table, tune_and_check
from tidepanel.operators import audit, baselines, compare, metrics, profile, quality
from tidepanel.operators import time_axis as axis
from tidepanel.operators.cross_section import with_cross_section
from tidepanel.operators.labels import join_labels, split_target
from tidepanel.operators.per_date import join_per_date
from tidepanel.plans import workflows
from tidepanel.session import shared_folder
from tidepanel.sources.brand_days import brand_day_panel, test_panel, train_panel
from tidepanel.sources.files import (
    KEY_TEMPLATE, TEST_FEATURES, TRAIN_FEATURES, TRAIN_LABELS, PanelFiles, file_positions, read_table, write_predictions, write_sign_predictions,
)

Query = Callable[[SparkSession, str], DataFrame]

# Columns of the distribution profiles.
PROFILED_RETURNS = ["RET_1", "RET_5", "RET_10", "RET_20"]
PROFILED_VOLUMES = ["SIGNED_VOLUME_1", "SIGNED_VOLUME_5", "SIGNED_VOLUME_10", "SIGNED_VOLUME_20"]
PROFILED = [S.TARGET, *PROFILED_RETURNS, *PROFILED_VOLUMES, S.TURNOVER]


def settled(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles half up, so that engines can be compared; never gives a negative zero."""
    scale = f"1e{digits}D"
    doubles = {f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)}
    return df.selectExpr(
        *[f"floor(`{c}` * {scale} + 0.5D) / {scale} as `{c}`" if c in doubles else f"`{c}`" for c in df.columns]
    )


def train(spark: SparkSession, root: str, turnover: bool = False) -> DataFrame:
    return train_panel(brand_day_panel(spark, root, turnover))


def kept_train(spark: SparkSession, root: str, *columns: str) -> DataFrame:
    """The columns that a query of several passes needs, derived once."""
    return kept(train(spark, root, S.TURNOVER in columns).select(*columns))


def test(spark: SparkSession, root: str, turnover: bool = False) -> DataFrame:
    return test_panel(brand_day_panel(spark, root, turnover))


# ---- panel, labels, features ----------------------------------------------

def q_panel(spark, root):
    return brand_day_panel(spark, root)  # the same floating point steps everywhere: nothing to round


def q_label_join(spark, root):
    features, target = split_target(train(spark, root).drop(S.LABEL))
    joined, _ = join_labels(features, target)
    return joined.select(S.ROW_ID, S.TS, S.ALLOCATION, "RET_1", S.TARGET, S.LABEL)


def _features(make, columns):
    def query(spark, root):
        return settled(make(train(spark, root)).select(S.ROW_ID, *columns))

    return query


def _ratio(df):
    return X.with_momentum_volatility_ratio(X.with_volatility(X.with_momentum(df)))


def q_feat_filled(spark, root):
    names = [*X.MOMENTUM, *X.VOLATILITY, *X.RATIO, *X.VOLUME]
    return settled(X.fill_zero(X.with_engineered(train(spark, root)), names).select(S.ROW_ID, *names))


def q_feat_cross_section(spark, root):
    names = X.AVERAGE_PERF + X.STD_PERF
    return settled(
        with_cross_section(kept_train(spark, root, S.ROW_ID, S.TS, *S.RETURNS)).select(S.ROW_ID, *names, *[f"ALLOCATIONS_{c}" for c in names])
    )


def q_test_features(spark, root):
    return settled(X.with_engineered(test(spark, root)).select(S.ROW_ID, S.TS, *X.MOMENTUM, *X.VOLATILITY, *X.RATIO, *X.VOLUME))


# ---- dates and folds -------------------------------------------------------

def q_date_axis(spark, root):
    return axis.date_axis(train(spark, root))


def q_axis_bounds(spark, root):
    return axis.axis_bounds(train(spark, root))


def q_axis_continuity(spark, root):
    return axis.axis_continuity(train(spark, root))


def q_folds(spark, root):
    return axis.expanding_fold_table(axis.date_axis(train(spark, root)))


def q_fold_stats(spark, root):
    return settled(axis.fold_stats(train(spark, root)))


def q_fold_checks(spark, root):
    dates = kept(axis.date_axis(train(spark, root)))
    return axis.fold_checks(dates, axis.collect_folds(axis.expanding_fold_table(dates)))


def q_fold_assignment(spark, root):
    df = kept_train(spark, root, S.ROW_ID, S.TS)
    return axis.assign_folds(df.select(S.ROW_ID, S.TS), axis.expanding_folds(df))


def q_holdout(spark, root):
    return settled(axis.holdout_report(train(spark, root)))


def q_holdout_rows(spark, root):
    return axis.with_holdout(kept_train(spark, root, S.ROW_ID, S.TS)).select(S.ROW_ID, "side")


def q_leak_check(spark, root):
    df = kept_train(spark, root, S.TS)
    folds = axis.expanding_folds(df)
    shared = None
    for fold in folds:
        fit, valid = axis.split_fold(df.select(S.TS), fold)
        found = axis.shared_dates(fit, valid).agg(F.lit(fold.fold).alias("fold"), F.count("*").alias("n_shared"))
        shared = found if shared is None else shared.unionByName(found)
    return shared


def q_tuning_split(spark, root):
    df = kept_train(spark, root, S.ROW_ID, S.TS)
    folds = axis.expanding_folds(df)
    rows = axis.tuning_rows(df, folds)
    return rows.select(S.ROW_ID, S.TS)


def q_date_kfold(spark, root):
    return axis.date_kfold(axis.date_axis(train(spark, root)), 8, seed=None)


def q_date_kfold_shuffled(spark, root):
    return axis.date_kfold(axis.date_axis(train(spark, root)), 8, seed=0)


# ---- baselines, metrics, comparison ---------------------------------------

def _baseline(name):
    def query(spark, root):
        return settled(baselines.evaluate_rules(train(spark, root), rules=[name]).drop("strategy"))

    return query


def q_baseline_table(spark, root):
    return settled(baselines.strategy_table(baselines.evaluate_rules(train(spark, root))))


def q_baseline_summary(spark, root):
    return settled(baselines.strategy_summary(baselines.evaluate_rules(train(spark, root))))


SCORED = [S.ROW_ID, S.TS, S.LABEL, *S.RETURNS[:3]]


def _scored(df: DataFrame, rule: str, slope: float) -> DataFrame:
    """Validation rows with the prediction of a rule and the reversal score."""
    valid = axis.assign_folds(df.select(*SCORED), axis.expanding_folds(df), axis.VALID)
    return with_rule(valid, rule).withColumn(S.PROBABILITY, rule_score(slope))


def q_metrics_rule_scores(spark, root):
    return settled(metrics.score_metrics(_scored(kept_train(spark, root, *SCORED), "reversal", 1.0)))


def _compared(spark, root):
    df = kept_train(spark, root, *SCORED)
    a = metrics.score_metrics(_scored(df, "momentum", -1.0))
    b = metrics.score_metrics(_scored(df, "reversal", 1.0))
    return compare.compare_results(a, b, "momentum", "reversal")


def q_compare_rules(spark, root):
    return settled(_compared(spark, root))


def q_folds_ahead(spark, root):
    return compare.folds_ahead(_compared(spark, root))


def q_comparison_means(spark, root):
    return settled(compare.numeric_means(_compared(spark, root)))


def q_cv_band(spark, root):
    return settled(metrics.cv_band(baselines.evaluate_rules(train(spark, root), rules=["reversal"])))


def q_sign_accuracy(spark, root):
    df = kept_train(spark, root, S.TS, "RET_1", S.TARGET)
    folds = axis.date_kfold(axis.date_axis(df), 8, seed=None)
    reversed_return = join_per_date(df, folds).withColumn("guess", -F.col("RET_1"))
    return settled(metrics.sign_accuracy(reversed_return, S.TARGET, "guess"))


# ---- audit and profile -----------------------------------------------------

def q_null_audit(spark, root):
    return settled(audit.null_counts(train(spark, root, True), [S.TURNOVER, *S.RETURNS, *S.VOLUMES]))


def q_null_columns(spark, root):
    return audit.columns_with_nulls(test(spark, root, True))


def q_null_by_class(spark, root):
    return settled(audit.null_counts(train(spark, root, True), [S.TURNOVER, *S.VOLUMES], by=S.LABEL))


def q_null_total(spark, root):
    return audit.null_total(test(spark, root, True))


def q_dup_keys(spark, root):
    return audit.duplicate_keys(train(spark, root))


def q_key_alignment(spark, root):
    features, target = split_target(kept_train(spark, root, S.ROW_ID, S.TARGET))
    return audit.key_alignment(features, target)


def q_distinct_counts(spark, root):
    return audit.distinct_counts(train(spark, root), [S.TS, S.ALLOCATION, S.GROUP])


def q_distinct_dates(spark, root):
    return audit.distinct_values(test(spark, root), S.TS)


def q_group_counts(spark, root):
    return audit.value_counts(train(spark, root), S.GROUP)


def q_top_allocations(spark, root):
    return audit.value_counts(train(spark, root), S.ALLOCATION, top=10)


def q_top_positive(spark, root):
    return settled(audit.class_counts_by_allocation(train(spark, root), top=10))


def q_allocation_classes(spark, root):
    return settled(audit.class_counts_by_allocation(train(spark, root)))


def q_category_diff(spark, root):
    panel = kept(brand_day_panel(spark, root, False).select(S.ALLOCATION, S.GROUP, S.TARGET, "date_idx", "n_dates"))
    return audit.category_difference(train_panel(panel), test_panel(panel), [S.ALLOCATION, S.GROUP])


def q_class_share(spark, root):
    return settled(audit.class_shares(train(spark, root)))


def q_rows_per_date(spark, root):
    return audit.rows_per_date(train(spark, root))


def q_date_profile(spark, root):
    return settled(profile.describe_rows_per_date(kept_train(spark, root, S.TS)))


def q_positive_rate(spark, root):
    return settled(audit.positive_rate_by_date(train(spark, root)))


def q_positive_rate_profile(spark, root):
    return settled(profile.describe_positive_rate(kept_train(spark, root, S.TS, S.LABEL)))


def q_ret_mean_by_class(spark, root):
    return settled(audit.mean_returns_by_class(train(spark, root)))


def q_preview(spark, root):
    return settled(audit.preview(train(spark, root).select(S.ROW_ID, S.TS, S.ALLOCATION, S.TARGET, S.LABEL)))


def q_describe(spark, root):
    return settled(profile.describe(kept_train(spark, root, *PROFILED), PROFILED))


def q_centre_lines(spark, root):
    return settled(profile.centre_lines(kept_train(spark, root, *PROFILED), PROFILED))


def q_box_stats(spark, root):
    return settled(profile.box_stats(kept_train(spark, root, *PROFILED), PROFILED))


def q_box_stats_by_class(spark, root):
    return settled(profile.box_stats(kept_train(spark, root, S.LABEL, S.TURNOVER, "RET_1"), [S.TURNOVER, "RET_1"], [S.LABEL]))


def q_histogram_target(spark, root):
    return settled(profile.histogram(kept_train(spark, root, S.TARGET), S.TARGET))


def q_density_target(spark, root):
    return settled(profile.density(kept_train(spark, root, S.TARGET), S.TARGET))


def q_density_zoom(spark, root):
    return settled(profile.density(kept_train(spark, root, S.TARGET), S.TARGET, window=(-0.01, 0.01)))


def q_density_profiled(spark, root):
    return settled(profile.densities(kept_train(spark, root, *PROFILED), PROFILED))


def q_density_exact(spark, root):
    return settled(profile.density_exact(kept_train(spark, root, "RET_1"), "RET_1"))


# ---- submission ------------------------------------------------------------

def q_submission(spark, root):
    return quality.build_submission(with_rule(test(spark, root), "reversal"))


def q_submission_checks(spark, root):
    rows = kept(test(spark, root).select(S.ROW_ID, "RET_1"))
    submission = quality.build_submission(with_rule(rows, "reversal"))
    return settled(quality.submission_report(submission, rows.select(S.ROW_ID)))


def q_run_report(spark, root):
    submission = quality.build_submission(with_rule(test(spark, root), "agr_reversal"))
    return settled(quality.prediction_report(submission))


def q_infinity_counts(spark, root):
    names = [*X.MOMENTUM, *X.VOLATILITY, *X.RATIO, *X.VOLUME]
    return quality.infinity_counts(X.with_engineered(test(spark, root)), names)


# ---- files -----------------------------------------------------------------

def exported(spark, root) -> PanelFiles:
    """The four input tables as CSV in a new folder of the job's shared path."""
    panel, folder = kept(brand_day_panel(spark, root)), shared_folder(spark, "panel-files")
    features, target = split_target(train_panel(panel).drop(S.LABEL))
    rows = test_panel(panel)
    for name, df in ((TRAIN_FEATURES, features), (TRAIN_LABELS, target), (TEST_FEATURES, rows), (KEY_TEMPLATE, rows.select(S.ROW_ID))):
        df.write.option("header", True).csv(f"{folder}/{name}.csv")
    return PanelFiles(spark, folder)


def q_csv_train(spark, root):
    files = exported(spark, root)
    joined, _ = join_labels(files.train_features(), files.train_labels())
    return joined.select(S.ROW_ID, S.TS, S.ALLOCATION, S.GROUP, S.TURNOVER, "RET_1", "RET_20", "SIGNED_VOLUME_1", "SIGNED_VOLUME_20", S.TARGET, S.LABEL)


def q_csv_test(spark, root):
    files = exported(spark, root)
    return files.test_features().join(files.key_template(), S.ROW_ID).select(S.ROW_ID, S.TS, S.ALLOCATION, "RET_1", "RET_20")


def q_csv_predictions(spark, root):
    rows = kept(test(spark, root).select(S.ROW_ID, "RET_1"))
    folder = shared_folder(spark, "predictions")
    rule = write_predictions(quality.build_submission(with_rule(rows, "reversal")), f"{folder}/rule.csv")
    sign = write_sign_predictions(rows, "RET_1", f"{folder}/sign.csv")
    back = [read_table(spark, path, S.SUBMISSION_SCHEMA) for path in (rule, sign)]
    return back[0].join(back[1].withColumnRenamed(S.PREDICTION, "sign"), S.ROW_ID)


def _written_submission(spark, root):
    """(paths of the key template and of predictions written in its order)."""
    files = exported(spark, root)
    template, out = f"{files.root}/{KEY_TEMPLATE}.csv", f"{shared_folder(spark, 'ordered')}/predictions.csv"
    predicted = quality.build_submission(with_rule(files.test_features(), "reversal"))
    return template, write_predictions(predicted, out, like=template)


def q_submission_order(spark, root):
    template, out = _written_submission(spark, root)
    return quality.order_report(file_positions(spark, out), file_positions(spark, template))


def q_submission_order_faulty(spark, root):
    """The first two rows of the written file change places."""
    template, out = _written_submission(spark, root)
    place = F.when(F.col("position") < 2, 1 - F.col("position")).otherwise(F.col("position"))
    swapped = file_positions(spark, out).withColumn("position", place)
    path = f"{shared_folder(spark, 'swapped')}/predictions"
    swapped.repartitionByRange("position").sortWithinPartitions("position").select(S.ROW_ID).write.parquet(path)
    return quality.order_report(file_positions(spark, path), file_positions(spark, template))


def q_run_submission(spark, root):
    files = exported(spark, root)
    out = f"{shared_folder(spark, 'submission')}/predictions.csv"
    return settled(workflows.run_submission(files, builders.level_wise_boosting(), out).drop("path"))


# ---- the same checks on inputs with faults ---------------------------------
# Faults follow from the given rows: keys divisible by a prime are doubled, dropped or spoilt.

def with_faulty_keys(df: DataFrame, doubled: int, dropped: int) -> DataFrame:
    key = F.col(S.ROW_ID)
    return df.where(key % dropped != 0).unionByName(df.where(key % doubled == 0))


def overlapping(folds):
    """Folds that train up to the first date (even numbers: the last date) of their validation block."""
    return [f._replace(train_end=f.valid_end if f.fold % 2 == 0 else f.valid_start) for f in folds]


def q_dup_keys_faulty(spark, root):
    return audit.duplicate_keys(with_faulty_keys(kept_train(spark, root, S.ROW_ID), 97, 89))


def q_key_alignment_faulty(spark, root):
    keys = kept_train(spark, root, S.ROW_ID)
    return audit.key_alignment(with_faulty_keys(keys, 97, 89), keys.where(F.col(S.ROW_ID) % 79 != 0))


def q_category_diff_faulty(spark, root):
    panel = kept(brand_day_panel(spark, root, False).select(S.ALLOCATION, S.GROUP, S.TARGET, "date_idx", "n_dates"))
    left, right = train_panel(panel).where(F.col(S.GROUP) != 2), test_panel(panel).where(F.col(S.GROUP) != 3)
    return audit.category_difference(left, right, [S.ALLOCATION, S.GROUP])


def q_leak_check_faulty(spark, root):
    df = kept_train(spark, root, S.TS)
    shared = None
    for fold in overlapping(axis.expanding_folds(df)):
        fit, valid = axis.split_fold(df, fold)
        found = axis.shared_dates(fit, valid).agg(F.lit(fold.fold).alias("fold"), F.count("*").alias("n_shared"))
        shared = found if shared is None else shared.unionByName(found)
    return shared


def q_fold_checks_faulty(spark, root):
    dates = kept(axis.date_axis(train(spark, root)))
    return axis.fold_checks(dates, overlapping(axis.collect_folds(axis.expanding_fold_table(dates))))


def q_submission_checks_faulty(spark, root):
    rows = kept(test(spark, root).select(S.ROW_ID, "RET_1"))
    key, good = F.col(S.ROW_ID), quality.build_submission(with_rule(rows, "reversal"))
    spoilt = F.when(key % 83 == 0, F.lit(None)).when(key % 71 == 0, 2).otherwise(F.col(S.PREDICTION)).cast("int")
    faulty = with_faulty_keys(good.withColumn(S.PREDICTION, spoilt), 97, 89)
    unknown = good.where(key % 67 == 0).withColumn(S.ROW_ID, -key)
    return settled(quality.submission_report(faulty.unionByName(unknown), rows.select(S.ROW_ID)))


def q_infinity_counts_faulty(spark, root):
    names = [*X.MOMENTUM, *X.VOLATILITY, *X.RATIO, *X.VOLUME]
    df = X.with_engineered(test(spark, root))
    spoilt = {n: F.when(F.col(S.ROW_ID) % (61 + 2 * k) == 0, F.lit(float("-inf" if k % 2 else "inf"))).otherwise(F.col(n)) for k, n in enumerate(names)}
    return quality.infinity_counts(df.withColumns(spoilt), names)


def sql_queries() -> dict[str, Query]:
    """Queries with an SQL twin."""
    found: dict[str, Query] = {
        "panel": q_panel,
        "label_join": q_label_join,
        "feat_momentum": _features(X.with_momentum, X.MOMENTUM),
        "feat_volatility": _features(X.with_volatility, X.VOLATILITY),
        "feat_ratio": _features(_ratio, X.RATIO),
        "feat_volume": _features(X.with_volume, X.VOLUME),
        "feat_all": _features(X.with_engineered, [*X.MOMENTUM, *X.VOLATILITY, *X.RATIO, *X.VOLUME]),
        "feat_filled": q_feat_filled,
        "feat_performance": _features(X.with_performance, [*X.AVERAGE_PERF, *X.STD_PERF]),
        "feat_cross_section": q_feat_cross_section,
        "feat_test": q_test_features,
        "date_axis": q_date_axis,
        "axis_bounds": q_axis_bounds,
        "axis_continuity": q_axis_continuity,
        "folds": q_folds,
        "fold_stats": q_fold_stats,
        "fold_checks": q_fold_checks,
        "fold_assignment": q_fold_assignment,
        "holdout_last120": q_holdout,
        "holdout_rows": q_holdout_rows,
        "leak_check": q_leak_check,
        "tuning_split": q_tuning_split,
        "date_kfold": q_date_kfold,
        "baseline_table": q_baseline_table,
        "baseline_summary": q_baseline_summary,
        "metrics_rule_scores": q_metrics_rule_scores,
        "compare_rules": q_compare_rules,
        "folds_beating": q_folds_ahead,
        "comparison_means": q_comparison_means,
        "cv_band": q_cv_band,
        "sign_accuracy": q_sign_accuracy,
        "null_audit": q_null_audit,
        "null_columns": q_null_columns,
        "null_by_class": q_null_by_class,
        "null_total": q_null_total,
        "dup_keys": q_dup_keys,
        "key_alignment": q_key_alignment,
        "distinct_counts": q_distinct_counts,
        "distinct_dates": q_distinct_dates,
        "group_counts": q_group_counts,
        "top_allocations": q_top_allocations,
        "top_positive_allocations": q_top_positive,
        "allocation_classes": q_allocation_classes,
        "category_diff": q_category_diff,
        "class_share": q_class_share,
        "rows_per_date": q_rows_per_date,
        "date_profile": q_date_profile,
        "positive_rate_by_date": q_positive_rate,
        "positive_rate_profile": q_positive_rate_profile,
        "ret_mean_by_class": q_ret_mean_by_class,
        "preview": q_preview,
        "describe": q_describe,
        "centre_lines": q_centre_lines,
        "box_stats": q_box_stats,
        "box_stats_by_class": q_box_stats_by_class,
        "histogram_target": q_histogram_target,
        "density_target": q_density_target,
        "density_zoom": q_density_zoom,
        "density_exact": q_density_exact,
        "density_profiled": q_density_profiled,
        "submission": q_submission,
        "submission_checks": q_submission_checks,
        "run_report": q_run_report,
        "infinity_counts": q_infinity_counts,
        "csv_train": q_csv_train,
        "csv_test": q_csv_test,
        "csv_predictions": q_csv_predictions,
        "dup_keys_faulty": q_dup_keys_faulty,
        "key_alignment_faulty": q_key_alignment_faulty,
        "category_diff_faulty": q_category_diff_faulty,
        "leak_check_faulty": q_leak_check_faulty,
        "fold_checks_faulty": q_fold_checks_faulty,
        "submission_checks_faulty": q_submission_checks_faulty,
        "infinity_counts_faulty": q_infinity_counts_faulty,
        "submission_order": q_submission_order,
        "submission_order_faulty": q_submission_order_faulty,
        "fold_moments": q_fold_moments,
        "ridge_folds": q_ridge_folds,
        "logit_folds": q_logit_folds,
        "boost_stumps": q_boost_stumps,
    }
    for name in baselines.baseline_names():
        found[f"baseline_{name}"] = _baseline(name)
    return found


# ---- learned models --------------------------------------------------------
# Whole tables, all folds and the models' default settings.

def modelling_panel(spark: SparkSession, root: str, turnover: bool = True) -> DataFrame:
    """Engineered train rows, kept because every fit reads them several times."""
    return kept(X.with_engineered(train(spark, root, turnover)))


def _evaluated(build: Callable, feature_set: str = "engineered"):
    def query(spark, root):
        df = modelling_panel(spark, root)
        return settled(evaluate.evaluate_model(df, axis.expanding_folds(df), build(), X.feature_sets()[feature_set]))

    return query


def q_ridge_scores(spark, root):
    panel = kept(brand_day_panel(spark, root))
    fit = kept(with_cross_section(train_panel(panel)))
    rows = with_cross_section(test_panel(panel))
    scored = workflows.fit_and_score(fit, rows, builders.ridge(), X.feature_sets()["performance"], S.TARGET)
    return settled(scored.select(S.ROW_ID, F.col(S.PREDICTION).alias("score"), class_of(S.PREDICTION).alias(S.PREDICTION)))


def _date_cv(spark, root):
    df = kept(with_cross_section(kept(train(spark, root, True))))
    return workflows.date_cv(df, X.feature_sets()["performance"], builders.boosted_regression())


def q_gbt_regression_cv(spark, root):
    scores, _ = _date_cv(spark, root)
    return settled(scores)


def q_importances(spark, root):
    _, gains = _date_cv(spark, root)
    return settled(evaluate.top_features(gains), 4)


# ---- learned models on few inputs, which SQL can fit as well -----------------
# Inputs, cut points and rounds of these checks.
SMALL_INPUTS, SMALL_CUTS, SMALL_ROUNDS = ("RET_1", "RET_2", "RET_3"), (-0.4, -0.1, 0.0, 0.1, 0.4), 3
STUMPS = {
    "adaboost": (builders.adaboost(SMALL_ROUNDS), S.LABEL),
    "level_wise": (builders.level_wise_boosting(SMALL_ROUNDS, max_depth=1, subsample=1.0, colsample_bytree=1.0), S.LABEL),
    "regression": (builders.boosted_regression(SMALL_ROUNDS, max_depth=1), S.TARGET),
}


def _fold_rows(spark, root, inputs, label):
    """(rows packed for linear models, number of folds) of the expanding folds."""
    df = kept_train(spark, root, S.ROW_ID, S.TS, S.LABEL, S.TARGET, *inputs)
    folds = axis.expanding_folds(df)
    return linear.packed_rows(evaluate.fold_bits(df, folds), inputs, label), len(folds)


def q_fold_moments(spark, root):
    names = [*SMALL_INPUTS, S.TARGET]
    rows, folds = _fold_rows(spark, root, SMALL_INPUTS, S.TARGET)
    table = [
        (f, m.n, a, b, float(m.mean[i]), float(m.second[i, j] / m.n))
        for f, m in enumerate(linear.fold_moments(rows, len(SMALL_INPUTS), folds), start=1)
        for i, a in enumerate(names) for j, b in enumerate(names) if j >= i
    ]
    return settled(spark.createDataFrame(table, "fold int, n long, a string, b string, mean_a double, covariance double"), 8)


def q_ridge_folds(spark, root):
    rows, folds = _fold_rows(spark, root, SMALL_INPUTS[:2], S.TARGET)
    fits = [linear.ridge_of(m, range(2), 1.0) for m in linear.fold_moments(rows, 2, folds)]
    table = [(f, float(w[0]), float(w[1]), b) for f, (w, b) in enumerate(fits, start=1)]
    return settled(spark.createDataFrame(table, "fold int, w1 double, w2 double, intercept double"), 8)


def q_logit_folds(spark, root):
    rows, folds = _fold_rows(spark, root, SMALL_INPUTS[:1], S.LABEL)
    table = [(p.fold + 1, p.n, float(p.w[0]), float(p.w[1])) for p in linear.fit_logits(rows, 1, folds, [[0]])]
    return settled(spark.createDataFrame(table, "fold int, n long, intercept double, slope double"))


def q_boost_stumps(spark, root):
    df = kept_train(spark, root, S.ROW_ID, S.LABEL, S.TARGET, *SMALL_INPUTS).withColumns({"train": F.lit(1), "valid": F.lit(0)})
    table = []
    for name, (plan, label) in STUMPS.items():
        models, rows = fit_folds(df, SMALL_INPUTS, label, 1, plan, [[np.array(SMALL_CUTS)] * len(SMALL_INPUTS)])
        nodes = models[0].nodes()
        for number, node, feature, cut, left, right, _, gain in nodes:
            if feature:
                value = {n: v for t, n, *_, v, _ in nodes if t == number}
                table.append((name, number, feature, cut, float(gain), value[left], value[right]))
        rows.unpersist()
    return settled(spark.createDataFrame(table, "model string, round int, feature string, cut double, gain double, left_value double, right_value double"))


NUMERIC = [S.GROUP, S.TURNOVER, *S.RETURNS, *S.VOLUMES]
SEARCH_TREES, FINAL_TREES = 50, 200


def _search_forest(**settings):
    return builders.random_forest(**{"n_estimators": SEARCH_TREES, **settings})


def q_grid_search(spark, root):
    df = modelling_panel(spark, root)
    folds = axis.expanding_folds(df)
    tuning, _ = axis.tuning_split(folds)
    scores = grid_scores(axis.tuning_rows(df, folds), tuning, _search_forest, FOREST_GRID, NUMERIC)
    return settled(grid_table(scores, FOREST_GRID).drop("mean_fit_time"))


def q_grid_best_holdout(spark, root):
    df = modelling_panel(spark, root)
    _, final = tune_and_check(df, axis.expanding_folds(df), _search_forest, FOREST_GRID, NUMERIC, final={"n_estimators": FINAL_TREES})
    return settled(final)


def q_feature_study(spark, root):
    df = kept(train(spark, root))
    return settled(workflows.feature_study(df, axis.expanding_folds(df), builders.logistic_regression()))


def q_model_submission(spark, root):
    panel = kept(brand_day_panel(spark, root))
    fit, rows = X.with_engineered(train_panel(panel)), X.with_engineered(test_panel(panel))
    features = X.numeric_features(fit)
    quality.check_features(fit, rows, features)
    scored = workflows.fit_and_score(fit, rows, builders.level_wise_boosting(), features)
    return quality.build_submission(scored)


def q_audit_report(spark, root):
    panel = kept(brand_day_panel(spark, root))
    features, target = split_target(train_panel(panel).drop(S.LABEL))
    rows = test_panel(panel)
    return workflows.audit_report(features, target, rows, rows.select(S.ROW_ID))


def model_queries() -> dict[str, Query]:
    """Iterative fits and other results without an SQL twin."""
    return {
        "date_kfold_shuffled": q_date_kfold_shuffled,
        "audit_report": q_audit_report,
        "ridge_scores": q_ridge_scores,
        "eval_logit": _evaluated(builders.logistic_regression, "raw"),
        "eval_tree": _evaluated(builders.decision_tree),
        "eval_forest": _evaluated(builders.random_forest),
        "eval_adaboost": _evaluated(builders.adaboost),
        "eval_gbt": _evaluated(builders.gradient_boosting),
        "eval_gbt_spark": _evaluated(builders.spark_gradient_boosting),
        "eval_xgb_like": _evaluated(builders.level_wise_boosting),
        "eval_lgbm_like": _evaluated(builders.leaf_wise_boosting),
        "eval_catboost_like": _evaluated(builders.symmetric_boosting),
        "gbt_regression_cv": q_gbt_regression_cv,
        "importances_top20": q_importances,
        "grid_search": q_grid_search,
        "grid_best_holdout": q_grid_best_holdout,
        "feature_study": q_feature_study,
        "model_submission": q_model_submission,
        "run_submission": q_run_submission,
    }
