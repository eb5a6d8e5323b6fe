"""Factories of untrained models with their default settings and argument checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier,
)
from pyspark.ml.feature import SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel import schema as S
from tidepanel.models.boosting import Boosting, subset_size
from tidepanel.models.forest import Forest

MAX_TREE_DEPTH = 30  # limit of Spark ML, stands for "no limit"
TREE_BINS = 128
VECTOR, WEIGHT = "__features", "__weight"


# ---- checks ----------------------------------------------------------------

def _positive(**values) -> None:
    for name, value in values.items():
        if value <= 0:
            raise ValueError(f"{name} must be positive, not {value}")


def _not_negative(**values) -> None:
    for name, value in values.items():
        if value < 0:
            raise ValueError(f"{name} must not be negative, not {value}")


def _share(**values) -> None:
    for name, value in values.items():
        if not 0 < value <= 1:
            raise ValueError(f"{name} must lie in (0, 1], not {value}")


# ---- Spark ML models -------------------------------------------------------

def assembling_stages(features: Sequence[str]) -> list:
    """NULL -> 0 and one vector column."""
    filled = ", ".join(f"coalesce(cast(`{c}` as double), 0D) AS `__x_{i}`" for i, c in enumerate(features))
    return [
        SQLTransformer(statement=f"SELECT *, {filled} FROM __THIS__"),
        VectorAssembler(inputCols=[f"__x_{i}" for i in range(len(features))], outputCol=VECTOR),
        SQLTransformer(statement=f"SELECT * EXCEPT ({', '.join(f'`__x_{i}`' for i in range(len(features)))}) FROM __THIS__"),
    ]


class FeatureModel:
    """An untrained Spark ML model that learns its feature list later: ``.on(features, label)``."""

    def on(self, features: Sequence[str], label: str = S.LABEL) -> Estimator:
        raise NotImplementedError


class _ScaledLogistic(Estimator):
    """Standardised logistic regression with the penalty of ``C * sum(loss) + |w|^2 / 2``.

    Spark averages the loss and scales by the n-1 deviation; both are put right
    with the number of rows, known only when fitting.
    """

    def __init__(self, features, label, C, max_iter, tolerance):
        super().__init__()
        self.features, self.label, self.C = list(features), label, C
        self.max_iter, self.tolerance = max_iter, tolerance

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        assembling = Pipeline(stages=assembling_stages(self.features)).fit(dataset)
        rows = assembling.transform(dataset).select(F.col(self.label).cast("double").alias(self.label), VECTOR)
        n = rows.count()
        if n < 2:
            raise ValueError("logistic regression needs at least two rows")
        scaler = StandardScaler(inputCol=VECTOR, outputCol="__scaled", withMean=True, withStd=True).fit(rows)
        model = LogisticRegression(
            featuresCol="__scaled", labelCol=self.label, regParam=(n - 1) / n / (self.C * n), elasticNetParam=0.0,
            standardization=False, maxIter=self.max_iter, tol=self.tolerance,
        ).fit(scaler.transform(rows))
        return PipelineModel(stages=[assembling, scaler, model])


@dataclass(frozen=True)
class LogisticModel(FeatureModel):
    C: float = 1.0
    max_iter: int = 1000
    tolerance: float = 1e-8

    def on(self, features, label=S.LABEL):
        return _ScaledLogistic(features, label, self.C, self.max_iter, self.tolerance)


def logistic_regression(C: float = 1.0, max_iter: int = 1000) -> LogisticModel:
    """Impute 0, standardise, L2 logistic regression (L-BFGS)."""
    _positive(C=C, max_iter=max_iter)
    return LogisticModel(C, max_iter)


class _Weighted(Estimator):
    """Adds class weights counted on the training rows, then fits."""

    def __init__(self, stages, classifier, label, class_weight):
        super().__init__()
        self.stages, self.classifier = stages, classifier
        self.label, self.class_weight = label, class_weight

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        weights = class_weights(dataset, self.label, self.class_weight)
        cases = F.lit(1.0)
        for value, weight in weights.items():
            cases = F.when(F.col(self.label) == value, F.lit(float(weight))).otherwise(cases)
        self.classifier.setWeightCol(WEIGHT)
        return Pipeline(stages=[*self.stages, self.classifier]).fit(dataset.withColumn(WEIGHT, cases))


def class_weights(df: DataFrame, label: str, rule: str | Mapping[int, float]) -> dict[int, float]:
    """``"balanced"``: n / (2 * n_class) from one count; a mapping is returned as it is."""
    if isinstance(rule, Mapping):
        return dict(rule)
    if rule != "balanced":
        raise ValueError(f"unknown class weight rule {rule!r}")
    counts = {row[label]: row["count"] for row in df.groupBy(label).count().collect()}
    return {value: sum(counts.values()) / (len(counts) * n) for value, n in counts.items()}


@dataclass(frozen=True)
class TreeModel(FeatureModel):
    """Decision tree (``trees`` = 1, no bootstrap) or random forest."""

    trees: int = 1
    max_depth: int | None = 5
    min_samples_leaf: int = 20
    max_features: int | float | str | None = None
    bootstrap: bool = False
    class_weight: str | Mapping[int, float] | None = None
    seed: int = 42

    def on(self, features, label=S.LABEL):
        common = dict(
            featuresCol=VECTOR, labelCol=label, maxDepth=self.max_depth or MAX_TREE_DEPTH, maxBins=TREE_BINS,
            minInstancesPerNode=self.min_samples_leaf, seed=self.seed,
        )
        tried = subset_size(self.max_features, len(features))
        if self.trees == 1 and not self.bootstrap and tried == len(features):
            classifier = DecisionTreeClassifier(**common)
        else:
            strategy = "all" if tried == len(features) else str(tried)
            classifier = RandomForestClassifier(
                numTrees=self.trees, featureSubsetStrategy=strategy, bootstrap=self.bootstrap, **common
            )
        stages = assembling_stages(features)
        if self.class_weight is not None:
            return _Weighted(stages, classifier, label, self.class_weight)
        return Pipeline(stages=[*stages, classifier])


def _check_trees(max_depth, min_samples_split, min_samples_leaf) -> None:
    if max_depth is not None and not 0 < max_depth <= MAX_TREE_DEPTH:
        raise ValueError(f"max_depth must be None or lie in 1..{MAX_TREE_DEPTH}")
    _positive(min_samples_leaf=min_samples_leaf)
    if min_samples_split > 2 * min_samples_leaf:
        raise ValueError("min_samples_split beyond twice min_samples_leaf is not supported by Spark ML trees")


def decision_tree(
    max_depth: int | None = 5, min_samples_split: int = 2, min_samples_leaf: int = 20,
    max_features=None, class_weight=None, seed: int = 42,
) -> TreeModel:
    """Impute 0, one classification tree."""
    _check_trees(max_depth, min_samples_split, min_samples_leaf)
    return TreeModel(1, max_depth, min_samples_leaf, max_features, False, class_weight, seed)


def random_forest(
    n_estimators: int = 200, max_depth: int | None = 8, min_samples_split: int = 2, min_samples_leaf: int = 20,
    max_features="sqrt", bootstrap: bool = True, oob_score: bool = False, class_weight=None, seed: int = 42,
) -> Forest:
    """Impute 0, random forest; all folds and candidates train in the same passes."""
    if oob_score and not bootstrap:
        raise ValueError("an out-of-bag score needs bootstrap samples")
    if oob_score:
        raise ValueError("out-of-bag scores are not available; use temporal folds")
    _positive(n_estimators=n_estimators, min_samples_leaf=min_samples_leaf)
    if max_depth is not None and not 0 < max_depth <= MAX_TREE_DEPTH:
        raise ValueError(f"max_depth must be None or lie in 1..{MAX_TREE_DEPTH}")
    if min_samples_split < 2:
        raise ValueError("min_samples_split must be at least 2")
    return Forest(
        n_estimators, MAX_TREE_DEPTH if max_depth is None else max_depth, min_samples_leaf, min_samples_split, max_features, bootstrap, class_weight,
        TREE_BINS, seed,
    )


class _Ridge(Estimator):
    def __init__(self, features, label, alpha):
        super().__init__()
        self.features, self.label, self.alpha = list(features), label, alpha

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        assembling = Pipeline(stages=assembling_stages(self.features)).fit(dataset)
        target = F.coalesce(F.col(self.label).cast("double"), F.lit(0.0)).alias("__label")
        rows = assembling.transform(dataset).select(target, VECTOR)
        size = rows.agg(F.count("*").alias("n"), F.stddev_pop("__label").alias("sd")).first()
        # Spark divides the objective by n and by the label's deviation
        penalty = self.alpha * (size["sd"] or 0.0) / size["n"]
        model = LinearRegression(
            featuresCol=VECTOR, labelCol="__label", solver="normal", elasticNetParam=0.0,
            standardization=False, regParam=penalty,
        ).fit(rows)
        return PipelineModel(stages=[assembling, model])


@dataclass(frozen=True)
class RidgeModel(FeatureModel):
    alpha: float = 1.0

    def on(self, features, label=S.TARGET):
        return _Ridge(features, label, self.alpha)


def ridge(alpha: float = 1.0) -> RidgeModel:
    """Impute 0 in features and target, L2 linear regression (normal equations)."""
    _not_negative(alpha=alpha)
    return RidgeModel(alpha)


# ---- boosted models --------------------------------------------------------

def adaboost(n_estimators: int = 100, learning_rate: float = 0.1, seed: int = 42) -> Boosting:
    """Impute 0, AdaBoost (SAMME) on stumps."""
    _positive(n_estimators=n_estimators, learning_rate=learning_rate)
    return Boosting(
        rounds=n_estimators, rate=learning_rate, max_depth=1, loss="exponential", criterion="gini", prior=False, seed=seed
    )


def gradient_boosting(
    n_estimators: int = 50, learning_rate: float = 0.05, max_depth: int = 2, min_samples_leaf: int = 20,
    subsample: float = 0.7, max_features="sqrt", seed: int = 42,
) -> Boosting:
    """Impute 0, gradient boosting with log-loss: variance splits, one Newton step per leaf."""
    _positive(
        n_estimators=n_estimators, learning_rate=learning_rate, max_depth=max_depth, min_samples_leaf=min_samples_leaf
    )
    _share(subsample=subsample)
    return Boosting(
        rounds=n_estimators, rate=learning_rate, max_depth=max_depth, criterion="variance", min_rows=min_samples_leaf,
        row_share=subsample, node_features=max_features, seed=seed,
    )


@dataclass(frozen=True)
class SparkGBT(FeatureModel):
    """The same family with Spark ML's own trainer (no Newton step, first tree unscaled)."""

    rounds: int
    rate: float
    max_depth: int
    min_samples_leaf: int
    subsample: float
    max_features: int | float | str | None
    seed: int
    regression: bool = False

    def on(self, features, label=S.LABEL):
        tried = subset_size(self.max_features, len(features))
        settings = dict(
            featuresCol=VECTOR, labelCol=label, maxIter=self.rounds, stepSize=self.rate, maxDepth=self.max_depth,
            minInstancesPerNode=self.min_samples_leaf, subsamplingRate=self.subsample, maxBins=TREE_BINS,
            featureSubsetStrategy="all" if tried == len(features) else str(tried), seed=self.seed,
        )
        learner = GBTRegressor(**settings) if self.regression else GBTClassifier(**settings)
        return Pipeline(stages=[*assembling_stages(features), learner])


def spark_gradient_boosting(
    n_estimators: int = 50, learning_rate: float = 0.05, max_depth: int = 2, min_samples_leaf: int = 20,
    subsample: float = 0.7, max_features="sqrt", seed: int = 42, regression: bool = False,
) -> SparkGBT:
    _positive(
        n_estimators=n_estimators, learning_rate=learning_rate, max_depth=max_depth, min_samples_leaf=min_samples_leaf
    )
    _share(subsample=subsample)
    return SparkGBT(
        n_estimators, learning_rate, max_depth, min_samples_leaf, subsample, max_features, seed, regression
    )


def level_wise_boosting(
    n_estimators: int = 50, learning_rate: float = 0.05, max_depth: int = 2, min_child_weight: float = 1.0,
    subsample: float = 0.7, colsample_bytree: float = 0.8, gamma: float = 0.0, reg_alpha: float = 0.0,
    reg_lambda: float = 1.0, seed: int = 42,
) -> Boosting:
    """Impute 0, second-order boosting grown level by level (XGBoost-like)."""
    _positive(n_estimators=n_estimators, learning_rate=learning_rate, max_depth=max_depth)
    _not_negative(min_child_weight=min_child_weight, gamma=gamma, reg_alpha=reg_alpha, reg_lambda=reg_lambda)
    _share(subsample=subsample, colsample_bytree=colsample_bytree)
    return Boosting(
        rounds=n_estimators, rate=learning_rate, max_depth=max_depth, min_hessian=min_child_weight, gamma=gamma,
        l1=reg_alpha, l2=reg_lambda, row_share=subsample, tree_features=colsample_bytree, seed=seed,
    )


def leaf_wise_boosting(
    n_estimators: int = 50, learning_rate: float = 0.05, num_leaves: int = 31, max_depth: int = 2,
    min_child_samples: int = 20, subsample: float = 0.7, subsample_freq: int = 1, colsample_bytree: float = 0.8,
    reg_alpha: float = 0.0, reg_lambda: float = 0.0, seed: int = 42,
) -> Boosting:
    """Impute 0, second-order boosting that splits the best leaf first (LightGBM-like)."""
    _positive(n_estimators=n_estimators, learning_rate=learning_rate, min_child_samples=min_child_samples)
    if num_leaves <= 1:
        raise ValueError("num_leaves must be at least 2")
    if max_depth == 0 or max_depth < -1:
        raise ValueError("max_depth must be -1 (no limit) or positive")
    _share(subsample=subsample, colsample_bytree=colsample_bytree)
    _not_negative(subsample_freq=subsample_freq, reg_alpha=reg_alpha, reg_lambda=reg_lambda)
    unlimited = max_depth == -1
    # without the leaf limit biting, whole levels give the same trees in fewer passes
    growth = "level" if not unlimited and 2**max_depth <= num_leaves else "leaf"
    return Boosting(
        rounds=n_estimators, rate=learning_rate, max_depth=num_leaves if unlimited else max_depth, growth=growth,
        max_leaves=num_leaves, min_rows=min_child_samples, min_hessian=1e-3, l1=reg_alpha, l2=reg_lambda,
        row_share=subsample, row_every=subsample_freq, tree_features=colsample_bytree, seed=seed,
    )


def symmetric_boosting(
    iterations: int = 100, learning_rate: float = 0.1, depth: int = 6, l2_leaf_reg: float = 3.0, seed: int = 42
) -> Boosting:
    """Impute 0, boosting on trees with one split per level (CatBoost-like, plain boosting)."""
    _positive(iterations=iterations, learning_rate=learning_rate, depth=depth)
    _not_negative(l2_leaf_reg=l2_leaf_reg)
    return Boosting(
        rounds=iterations, rate=learning_rate, max_depth=depth, growth="symmetric", l2=l2_leaf_reg, prior=False, seed=seed
    )


def boosted_regression(
    rounds: int = 500, learning_rate: float = 0.01, max_depth: int = 3, num_leaves: int = 31,
    min_child_samples: int = 20, seed: int = 42,
) -> Boosting:
    """Squared-loss boosting of a continuous target; NULL counts as 0."""
    return leaf_wise_boosting(
        rounds, learning_rate, num_leaves, max_depth, min_child_samples, 1.0, 1, 1.0, 0.0, 0.0, seed
    ).with_settings(loss="squared")
