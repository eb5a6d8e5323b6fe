"""Whole studies, each from an input panel to result tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel import schema as S
from tidepanel.functions import features as X
from tidepanel.functions.rules import class_of
from tidepanel.functions.sizing import kept
from tidepanel.models import builders, evaluate
from tidepanel.models.boosting import Boosting, fit_folds, score_folds
from tidepanel.models.forest import VALID, Forest, score_forests
from tidepanel.models.tuning import FOREST_GRID, tune_and_check
from tidepanel.operators import audit, baselines, compare, metrics, profile, quality
from tidepanel.operators import time_axis as axis
from tidepanel.operators.cross_section import with_cross_section
from tidepanel.operators.labels import join_labels
from tidepanel.operators.per_date import join_per_date
from tidepanel.sources.files import PanelFiles, read_table, write_predictions

# Feature sets of the feature study, the reference first.
FEATURE_STUDY = ("raw", "momentum", "momentum_compact", "volatility", "momentum_volatility", "ratio", "volume")


# ---- fitting and scoring ---------------------------------------------------

def fit_and_score(
    train: DataFrame, test: DataFrame, model, features: Sequence[str], label: str = S.LABEL
) -> DataFrame:
    """Fit on all of ``train`` and add prediction (and p1) to ``test``."""
    if isinstance(model, Boosting):
        marked = train.withColumns({"train": F.lit(1), "valid": F.lit(0)})
        models, _ = fit_folds(marked, features, label, 1, model)
        return models[0].transform(test)
    if isinstance(model, Forest):
        columns = [S.ROW_ID, *features]
        sides = train.select(*columns, label, F.lit(1).alias("train"), F.lit(0).alias("valid")).unionByName(
            test.select(*columns, F.lit(0).cast(train.schema[label].dataType).alias(label), F.lit(0).alias("train"), F.lit(1).alias("valid"))
        )
        scored = score_forests(sides, features, label, 1, [model]).where(F.col("side") == VALID)
        return test.join(scored.select(S.ROW_ID, S.PROBABILITY, S.PREDICTION), S.ROW_ID)
    fitted = evaluate.bind(model, features, label).fit(train)
    scored = fitted.transform(test)
    return evaluate.with_probability(scored) if "probability" in scored.columns else scored


def run_submission(
    files: PanelFiles, model, out: str, features: Sequence[str] | None = None, single_file: bool = False
) -> DataFrame:
    """Load, label, engineer, check, fit on all rows, predict, check, write; returns the run report."""
    test = X.with_engineered(files.test_features())
    labelled, _ = join_labels(files.train_features(), files.train_labels())
    # kept: the checks, the sketches and every pass of the fit read the same rows
    train = kept(X.with_engineered(labelled))
    features = list(features or X.numeric_features(train))
    quality.check_features(train, test, features)
    scored = fit_and_score(train, test, model, features)
    # kept: the checks and the writer read the same predictions
    submission = kept(quality.build_submission(scored))
    quality.check_submission(submission, test.select(S.ROW_ID))
    write_predictions(submission, out, single_file)
    report = quality.prediction_report(read_table(files.spark, out, S.SUBMISSION_SCHEMA))
    for table in (train, submission):
        table.unpersist()
    return report.withColumn("path", F.lit(out))


# ---- reports ---------------------------------------------------------------

def audit_report(train: DataFrame, labels: DataFrame, test: DataFrame, keys: DataFrame) -> DataFrame:
    """Data-understanding report as (check, subject, column, value)."""
    def entry(df: DataFrame, check: str, subject: str, column, value) -> DataFrame:
        return df.select(
            F.lit(check).alias("check"), F.lit(subject).alias("subject"),
            (column if not isinstance(column, str) else F.lit(column)).alias("column"),
            value.cast("double").alias("value"),
        )

    tables = {"train": train, "labels": labels, "test": test, "keys": keys}
    parts = []
    for name, df in tables.items():
        parts.append(entry(audit.null_counts(df), "missing values", name, F.col("column"), F.col("nb_missing")))
        sizes = audit.duplicate_keys(df)
        parts.append(entry(sizes, "rows", name, S.ROW_ID, F.col("n_rows")))
        parts.append(entry(sizes, "duplicate keys", name, S.ROW_ID, F.col("n_duplicates")))
    for name, a, b in (("train and labels", train, labels), ("test and keys", test, keys)):
        parts.append(entry(audit.key_alignment(a, b), "aligned keys", name, S.ROW_ID, F.col("aligned").cast("int")))
    same = train.sparkSession.createDataFrame([(int(audit.same_columns(train, test)),)], "same int")
    parts.append(entry(same, "same columns", "train and test", "*", F.col("same")))
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report


def profile_report(train: DataFrame, test: DataFrame, columns: Sequence[str]) -> dict[str, DataFrame]:
    """Exploration report: one lazily computed table per topic."""
    tables = {
        "class_share": audit.class_shares(train),
        "describe": profile.describe(train, columns),
        "box_stats": profile.box_stats(train, columns),
        "rows_per_date": profile.describe_rows_per_date(train),
        "positive_rate": profile.describe_positive_rate(train),
        "mean_returns": audit.mean_returns_by_class(train),
        "missing": audit.null_counts(train, [S.TURNOVER, *S.RETURNS, *S.VOLUMES], by=S.LABEL),
        "categories": audit.category_difference(train, test, [S.ALLOCATION, S.GROUP]),
        "groups": audit.value_counts(train, S.GROUP),
        "top_allocations": audit.value_counts(train, S.ALLOCATION, top=10),
        "top_positive": audit.class_counts_by_allocation(train, top=10),
        "histogram": profile.histogram(train, S.TARGET),
    }
    for column in columns:
        tables[f"density_{column}"] = profile.density(train, column)
    return tables


# ---- studies ---------------------------------------------------------------

def baseline_study(df: DataFrame, folds=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(results per strategy and fold, strategies side by side, summary)."""
    results = baselines.evaluate_rules(df, folds)
    return results, baselines.strategy_table(results), baselines.strategy_summary(results)


def feature_study(
    df: DataFrame, folds, model=None, sets: Mapping[str, Sequence[str]] | None = None, reference: str = "raw"
) -> DataFrame:
    """One row per feature set: mean and deviation over folds, folds ahead of the reference, decision.

    ``keep`` needs a better mean accuracy and more than half of the folds ahead.
    """
    model = model or builders.logistic_regression()
    known = X.feature_sets()
    sets = dict(sets or {name: known[name] for name in FEATURE_STUDY})
    columns = list(dict.fromkeys(c for names in sets.values() for c in names))
    rows = kept(X.with_engineered(df).select(S.ROW_ID, S.TS, S.LABEL, *columns))
    table = None
    if isinstance(model, builders.LogisticModel):  # all sets in the same passes
        scored = evaluate.logistic_sets(rows, folds, model, list(sets.values()))
        result = metrics.score_metrics(scored, ["set", "fold"])
        known = rows.sparkSession.createDataFrame([(i, name, len(names)) for i, (name, names) in enumerate(sets.items())], "set int, feature_set string, n_features int")
        table = result.join(F.broadcast(known), "set").select("feature_set", "n_features", "fold", "accuracy", "roc_auc", "log_loss")
        sets = {}
    for name, names in sets.items():
        result = evaluate.evaluate_model(rows, folds, model, names)
        result = result.select(F.lit(name).alias("feature_set"), F.lit(len(names)).alias("n_features"), "fold", "accuracy", "roc_auc", "log_loss")
        table = result if table is None else table.unionByName(result)
    table = kept(table)
    # every fold of a set beside that of the reference: as many rows as sets times folds
    first = table.where(F.col("feature_set") == reference).select("fold", F.col("accuracy").alias("first"))
    delta = F.col("accuracy") - F.col("first")
    summary = table.join(first, "fold").groupBy("feature_set").agg(
        F.first("n_features").alias("n_features"),
        F.avg("accuracy").alias("mean_accuracy"), F.stddev_samp("accuracy").alias("std_accuracy"),
        F.avg("roc_auc").alias("mean_roc_auc"), F.avg("log_loss").alias("mean_log_loss"),
        F.count_if(delta > 0).alias("ahead"), F.avg(delta).alias("gain"), F.count("*").alias("n_folds"),
    )
    is_reference = F.col("feature_set") == reference
    better = (F.col("gain") > 0) & (F.col("ahead") * 2 > F.col("n_folds"))
    return summary.select(
        "feature_set", "n_features", "mean_accuracy", "std_accuracy", "mean_roc_auc", "mean_log_loss",
        F.when(~is_reference, F.col("ahead")).alias("folds_ahead"),
        F.when(is_reference, "reference").otherwise(F.when(better, "keep").otherwise("reject")).alias("decision"),
    )


def model_study(df: DataFrame, folds, models: Mapping[str, object], features: Sequence[str]) -> DataFrame:
    """Fold results of several models under one column ``model``."""
    rows = df if df.is_cached else kept(df.select(*dict.fromkeys([S.ROW_ID, S.TS, S.LABEL, *features])))
    table = None
    for name, model in models.items():
        result = evaluate.evaluate_model(rows, folds, model, features).withColumn("model", F.lit(name))
        table = result if table is None else table.unionByName(result)
    return table


def tree_study(df: DataFrame, folds, features: Sequence[str], grid=None, search_trees: int = 50, final_trees: int = 200):
    """(tree and forest results, grid table, best forest on the untouched last fold)."""
    first = model_study(
        df, folds, {"tree": builders.decision_tree(), "forest": builders.random_forest(n_estimators=final_trees)}, features
    )
    table, final = tune_and_check(
        df, folds, lambda **s: builders.random_forest(**{"n_estimators": search_trees, **s}), grid or FOREST_GRID,
        features, final={"n_estimators": final_trees},
    )
    return first, table, final


def boosting_study(df: DataFrame, folds, features: Sequence[str] | None = None) -> DataFrame:
    """All boosted model families with their default settings."""
    engineered = X.with_engineered(df)
    models = {
        "adaboost": builders.adaboost(),
        "gradient_boosting": builders.gradient_boosting(),
        "level_wise": builders.level_wise_boosting(),
        "leaf_wise": builders.leaf_wise_boosting(),
        "symmetric": builders.symmetric_boosting(),
    }
    return model_study(engineered, folds, models, features or X.numeric_features(engineered))


def date_cv(
    df: DataFrame, features: Sequence[str], model: Boosting, n_splits: int = 8, seed: int | None = 0, target: str = S.TARGET
) -> tuple[DataFrame, DataFrame]:
    """(sign accuracy per date fold, importances); all folds train in the same passes.

    The folds are shuffled dates: models see later dates than they are tested on.
    """
    folds = axis.date_kfold(axis.date_axis(df), n_splits, seed)
    everywhere = (1 << n_splits) - 1
    bits = folds.select(
        S.TS,
        F.pow(F.lit(2), F.col("fold")).cast("int").alias("valid"),
    ).withColumn("train", F.lit(everywhere) - F.col("valid"))
    models, rows = fit_folds(join_per_date(df, bits), features, target, n_splits, model)
    scores = metrics.sign_accuracy(score_folds(rows, models), "y", "margin")
    return scores, evaluate.importances(models, df.sparkSession)


def benchmark_study(
    train: DataFrame, test: DataFrame, alpha: float = 1.0, boosted: Boosting | None = None, n_splits: int = 8
) -> dict[str, DataFrame]:
    """Ridge and boosted regression on performance features, date CV, importances, sign predictions."""
    boosted = boosted or builders.boosted_regression()
    features = X.feature_sets()["performance"]
    train = kept(with_cross_section(train))
    test = with_cross_section(test)
    linear = fit_and_score(train, test, builders.ridge(alpha), features, S.TARGET)
    trees = fit_and_score(train, test, boosted, features, S.TARGET)
    scores, gains = date_cv(train, features, boosted, n_splits)
    return {
        "ridge": linear.select(S.ROW_ID, class_of(S.PREDICTION).alias(S.PREDICTION)),
        "boosted": trees.select(S.ROW_ID, class_of("margin").alias(S.PREDICTION)),
        "cv_scores": scores,
        "cv_band": metrics.cv_band(scores),
        "top_features": evaluate.top_features(gains),
    }
