"""Linear models from sums over rows, against Spark ML and against models fitted alone."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel import schema as S
from tidepanel.models import boosting as B
from tidepanel.models import builders, evaluate, linear
from tidepanel.plans.workflows import feature_study

FEATURES = S.RETURNS[:6]


def test_ridge_of_every_fold_equals_a_fit_alone(train, folds):
    rows = linear.packed_rows(evaluate.fold_bits(train, folds), FEATURES, S.TARGET)
    for fold, moments in zip(folds, linear.fold_moments(rows, len(FEATURES), len(folds))):
        own = train.where(F.col(S.TS).between(fold.train_start, fold.train_end))
        assert moments.n == own.count()
        for names in (FEATURES, FEATURES[2:4]):
            w, intercept = linear.ridge_of(moments, [FEATURES.index(c) for c in names], 2.5)
            model = builders.ridge(2.5).on(names, S.TARGET).fit(own).stages[-1]
            assert w == pytest.approx(model.coefficients.toArray(), abs=1e-9) and intercept == pytest.approx(model.intercept, abs=1e-9)


def test_large_means_cost_no_digits(train):
    shifted = train.select(S.ROW_ID, *[(F.coalesce(F.col(c), F.lit(0.0)) + 1e7).alias(c) for c in FEATURES], S.TARGET).withColumns({"train": F.lit(1), "valid": F.lit(0)})
    plain = train.withColumns({"train": F.lit(1), "valid": F.lit(0)})
    a, b = (linear.fold_moments(linear.packed_rows(df, FEATURES, S.TARGET), len(FEATURES), 1)[0] for df in (shifted, plain))
    assert a.second == pytest.approx(b.second, abs=1e-4)


def test_logistic_of_every_fold_equals_spark(train, folds):
    scored = evaluate.scored_folds(train, folds, builders.logistic_regression(0.5), FEATURES)
    mine = {(r["fold"], r[S.ROW_ID]): (r["p1"], r[S.PREDICTION]) for r in scored.collect()}
    for number, fold in enumerate(folds, start=1):
        own = train.where(F.col(S.TS).between(fold.train_start, fold.train_end))
        valid = train.where(F.col(S.TS).between(fold.valid_start, fold.valid_end))
        fitted = builders.logistic_regression(0.5).on(FEATURES, S.LABEL).fit(own)
        for r in evaluate.with_probability(fitted.transform(valid)).collect():
            p, prediction = mine.pop((number, r[S.ROW_ID]))
            assert p == pytest.approx(r["p1"], abs=2e-5) and prediction == int(p > 0.5)
    assert not mine


def test_gradient_is_zero_and_sets_do_not_touch_each_other(train, folds):
    rows = linear.packed_rows(evaluate.fold_bits(train, folds[:2]), FEATURES, S.LABEL)
    together = linear.fit_logits(rows, len(FEATURES), 2, [range(6), [1, 4]])
    alone = linear.fit_logits(rows, len(FEATURES), 2, [[1, 4]])
    assert [p.w for p in together if p.set == 1] == [pytest.approx(p.w) for p in alone] and all(p.done and p.steps < 12 for p in together)
    fold = folds[0]
    own = train.where(F.col(S.TS).between(fold.train_start, fold.train_end)).fillna(0.0, FEATURES).toPandas()
    p = together[0]
    z = p.design(own[FEATURES].to_numpy(float))
    gradient = z.T @ (1 / (1 + np.exp(-z @ p.w)) - own[S.LABEL].to_numpy(float)) + np.concatenate([[0], p.w[1:]])
    assert np.abs(gradient).max() < 1e-6 * len(own)


def test_constant_features_and_one_class(train):
    df = train.withColumns({"train": F.lit(1), "valid": F.lit(1), "flat": F.lit(3.0), "one": F.lit(1)})
    rows = linear.packed_rows(df, ["RET_1", "flat"], S.LABEL)
    both, plain = linear.fit_logits(rows, 2, 1, [[0, 1], [0]])
    assert both.w[:2] == pytest.approx(plain.w) and both.w[2] == 0
    only = linear.packed_rows(df, ["RET_1"], "one")
    assert linear.score_logits(only, 1, linear.fit_logits(only, 1, 1, [[0]])).where("p1 < 0.999").count() == 0


def test_feature_study_equals_sets_one_by_one(train, folds):
    sets = {"raw": S.RETURNS[:3], "few": ["momentum_3", "RET_1"]}
    table = {r["feature_set"]: r for r in feature_study(train, folds[:2], builders.logistic_regression(), sets).collect()}
    alone = evaluate.evaluate_model(train, folds[:2], builders.logistic_regression(), sets["raw"]).agg(F.avg("accuracy"), F.avg("roc_auc")).first()
    assert (table["raw"]["mean_accuracy"], table["raw"]["mean_roc_auc"]) == pytest.approx(tuple(alone)) and table["few"]["n_features"] == 2
    assert table["raw"]["decision"] == "reference" and table["few"]["folds_ahead"] in (0, 1, 2)


def test_given_cut_points_and_nodes(train):
    df = train.withColumns({"train": F.lit(1), "valid": F.lit(0)})
    cuts = [[np.array([-0.1, 0.1])] * 2]
    models, _ = B.fit_folds(df, FEATURES[:2], S.LABEL, 1, B.Boosting(rounds=2, rate=0.3, max_depth=2, l2=1.0), cuts)
    nodes = models[0].nodes()
    assert {n[3] for n in nodes if n[2]} <= {-0.1, 0.1} and {n[0] for n in nodes} == {1, 2}
    for tree, node, feature, _, left, right, value, gain in nodes:
        assert (feature is None) == (value is not None) == (gain is None)
        assert feature is None or {(tree, left), (tree, right)} <= {n[:2] for n in nodes}
    with pytest.raises(ValueError):
        B.fit_folds(df, FEATURES[:1], S.LABEL, 1, B.Boosting(rounds=1, rate=0.3, bins=2), [[np.array([0.0, 0.1])]])
