import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel import schema as S
from tidepanel.models import boosting as B
from tidepanel.models import builders, evaluate, tuning
from tidepanel.models.trees_numpy import gradients, margin_of, sampled

FEATURES = S.RETURNS[:5]


@pytest.fixture(scope="module")
def matrix(train):
    rows = train.fillna(0.0, FEATURES).select(*FEATURES, S.LABEL, S.TARGET).toPandas()
    return rows[FEATURES].to_numpy(), rows[S.LABEL].to_numpy(), rows[S.TARGET].fillna(0.0).to_numpy()


def test_ridge_equals_normal_equations(train, matrix):
    x, _, y = matrix
    xc, yc = x - x.mean(axis=0), y - y.mean()
    expected = np.linalg.solve(xc.T @ xc + 3.0 * np.eye(x.shape[1]), xc.T @ yc)
    model = builders.ridge(3.0).on(FEATURES, S.TARGET).fit(train).stages[-1]
    assert model.coefficients.toArray() == pytest.approx(expected, abs=1e-6)
    assert model.intercept == pytest.approx(y.mean() - x.mean(axis=0) @ expected, abs=1e-6)


def test_logistic_reaches_the_optimum_of_the_penalised_loss(train, matrix):
    x, y, _ = matrix
    C = 0.01
    model = builders.LogisticModel(C, 500, 1e-12).on(FEATURES).fit(train).stages[-1]
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    n = len(y)
    w = model.coefficients.toArray() * math.sqrt((n - 1) / n)  # from the n-1 to the n deviation
    p = 1 / (1 + np.exp(-(z @ w + model.intercept)))
    gradient = C * z.T @ (p - y) + w
    assert np.abs(gradient).max() < 1e-3 * C * n and abs((p - y).sum()) / n < 1e-6


def test_logistic_ignores_row_order(train):
    a = builders.logistic_regression().on(FEATURES).fit(train).stages[-1]
    b = builders.logistic_regression().on(FEATURES).fit(train.repartition(11)).stages[-1]
    assert a.coefficients.toArray() == pytest.approx(b.coefficients.toArray(), abs=1e-4)


BAD = [
    (builders.adaboost, dict(n_estimators=0)),
    (builders.adaboost, dict(learning_rate=0)),
    (builders.gradient_boosting, dict(max_depth=0)),
    (builders.gradient_boosting, dict(subsample=1.5)),
    (builders.gradient_boosting, dict(min_samples_leaf=0)),
    (builders.level_wise_boosting, dict(min_child_weight=-1)),
    (builders.level_wise_boosting, dict(colsample_bytree=0)),
    (builders.level_wise_boosting, dict(reg_lambda=-1)),
    (builders.leaf_wise_boosting, dict(num_leaves=1)),
    (builders.leaf_wise_boosting, dict(max_depth=0)),
    (builders.leaf_wise_boosting, dict(subsample_freq=-1)),
    (builders.symmetric_boosting, dict(depth=0)),
    (builders.symmetric_boosting, dict(l2_leaf_reg=-1)),
    (builders.random_forest, dict(oob_score=True, bootstrap=False)),
    (builders.random_forest, dict(n_estimators=0)),
    (builders.decision_tree, dict(max_depth=31)),
    (builders.ridge, dict(alpha=-1)),
    (builders.logistic_regression, dict(C=0)),
]


@pytest.mark.parametrize("build,settings", BAD)
def test_bad_settings_are_refused(build, settings):
    with pytest.raises(ValueError):
        build(**settings)


def test_class_weights(spark, train):
    df = spark.createDataFrame([(0,)] * 3 + [(1,)], "class int")
    assert builders.class_weights(df, "class", "balanced") == {0: 4 / 6, 1: 2.0}
    assert builders.class_weights(df, "class", {0: 1.0, 1: 5.0}) == {0: 1.0, 1: 5.0}
    negatives = []
    for weight in (None, "balanced", {0: 1.0, 1: 1000.0}):
        fitted = builders.decision_tree(class_weight=weight).on(FEATURES).fit(train)
        negatives.append(fitted.transform(train).where("prediction = 0").count())
    assert negatives[2] < negatives[1] / 10 and negatives[0] > 0


def one_fold(train):
    return train.withColumns({"train": F.lit(1), "valid": F.lit(1)})


def training_loss(models, rows):
    scored = B.score_folds(rows, models).toPandas()
    p = scored["p1"].clip(1e-15, 1 - 1e-15)
    return float(-(scored["y"] * np.log(p) + (1 - scored["y"]) * np.log(1 - p)).mean())


def plain(**settings):
    return B.Boosting(rounds=1, rate=0.5, max_depth=2, l2=1.0).with_settings(**settings)


@pytest.mark.parametrize("growth", ["level", "leaf", "symmetric"])
def test_training_loss_falls(train, growth):
    losses = []
    for rounds in (1, 3, 6):
        plan = plain(rounds=rounds, growth=growth, max_leaves=4)
        losses.append(training_loss(*B.fit_folds(one_fold(train), FEATURES, S.LABEL, 1, plan)))
    assert losses[0] < math.log(2) and losses[0] > losses[1] > losses[2]


def test_first_split_matches_brute_force(train, matrix):
    """Histogram split of the root against a search over all rows and cut points."""
    x, y, _ = matrix
    models, _ = B.fit_folds(one_fold(train), FEATURES, S.LABEL, 1, plain(max_depth=1))
    model, tree = models[0], models[0].trees[0]
    prior = math.log(y.mean() / (1 - y.mean()))
    assert model.prior == pytest.approx(prior)
    g, h = gradients("logistic", y, np.full(len(y), prior))
    score = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1.0)
    everything = np.ones(len(y), dtype=bool)
    best = max(
        (score(low) + score(~low) - score(everything), j, cut)
        for j in range(x.shape[1]) for cut in model.edges[j] for low in [x[:, j] <= cut] if 0 < low.sum() < len(y)
    )
    assert tree.gain[0] == pytest.approx(best[0]) and tree.feature[0] == best[1]
    assert model.edges[best[1]][tree.cut[0]] == best[2]
    low = x[:, best[1]] <= best[2]
    assert tree.value[tree.left[0]] == pytest.approx(-0.5 * g[low].sum() / (h[low].sum() + 1.0))


def test_folds_trained_together_equal_folds_trained_alone(train, folds):
    plan = plain(rounds=3)
    together, _ = B.fit_folds(evaluate.fold_bits(train, folds), FEATURES, S.LABEL, len(folds), plan)
    for k, fold in enumerate(folds):
        alone, _ = B.fit_folds(evaluate.fold_bits(train, [fold]), FEATURES, S.LABEL, 1, plan)
        assert all(np.array_equal(a, b) for a, b in zip(together[k].edges, alone[0].edges))
        assert [t.feature for t in alone[0].trees] == [t.feature for t in together[k].trees]
        assert [t.value for t in alone[0].trees] == [pytest.approx(t.value) for t in together[k].trees]
    assert together[0].prior != together[3].prior


def test_cut_points_ignore_validation_rows(train):
    bits = train.withColumn("valid", F.pow(F.lit(2), F.pmod(F.col(S.ROW_ID), F.lit(3))).cast("int"))
    bits = bits.withColumn("train", F.lit(7) - F.col("valid"))
    moved = bits.withColumn(FEATURES[0], F.when(F.col("valid") == 2, F.col(FEATURES[0]) * 1000).otherwise(F.col(FEATURES[0])))
    before, after = (B.feature_edges(df, FEATURES, 64, 3) for df in (bits, moved))
    assert all(np.array_equal(a, b) for a, b in zip(before[1], after[1]))
    assert not np.array_equal(before[0][0], after[0][0])


def test_leaf_growth_without_limit_equals_levels(train):
    a, _ = B.fit_folds(one_fold(train), FEATURES, S.LABEL, 1, plain(rounds=2, max_depth=3))
    b, _ = B.fit_folds(one_fold(train), FEATURES, S.LABEL, 1, plain(rounds=2, max_depth=3, growth="leaf", max_leaves=8))
    codes = np.random.default_rng(0).integers(0, 64, (500, 5)).astype(np.uint8)
    assert margin_of(a[0].trees, codes) == pytest.approx(margin_of(b[0].trees, codes))
    c, _ = B.fit_folds(one_fold(train), FEATURES, S.LABEL, 1, plain(max_depth=5, growth="leaf", max_leaves=6))
    assert len(c[0].trees[0].leaves()) == 6


def test_symmetric_trees_share_their_splits(train):
    models, _ = B.fit_folds(one_fold(train), FEATURES, S.LABEL, 1, plain(max_depth=3, growth="symmetric"))
    tree = models[0].trees[0]
    for depth in range(3):
        level = {(tree.feature[i], tree.cut[i]) for i in range(len(tree.left)) if tree.depth[i] == depth and tree.left[i] >= 0}
        assert len(level) == 1


def test_stored_margins_do_not_change_the_model(train, monkeypatch):
    plan = plain(rounds=5, row_share=0.7, tree_features=0.8)
    a, _ = B.fit_folds(one_fold(train), FEATURES, S.LABEL, 1, plan)
    monkeypatch.setattr(B, "REFRESH", 2)
    b, rows = B.fit_folds(one_fold(train), FEATURES, S.LABEL, 1, plan)
    assert [t.feature for t in a[0].trees] == [t.feature for t in b[0].trees]
    for t, u in zip(a[0].trees, b[0].trees):
        assert t.value == pytest.approx(u.value)
    assert B.score_folds(rows, b).count() == train.count()


def test_scoring_new_rows_equals_scoring_binned_rows(train):
    models, rows = B.fit_folds(one_fold(train), FEATURES, S.LABEL, 1, plain(rounds=4))
    a = B.score_folds(rows, models).select(S.ROW_ID, "p1", S.PREDICTION)
    b = models[0].transform(train).select(S.ROW_ID, F.col("p1").alias("q"), F.col(S.PREDICTION).alias("r"))
    both = a.join(b, S.ROW_ID)
    assert both.count() == train.count()
    assert both.where("abs(p1 - q) > 1e-12 or prediction <> r").count() == 0


def test_adaboost_weights_and_votes(train, matrix):
    x, y, _ = matrix
    models, _ = B.fit_folds(one_fold(train), FEATURES, S.LABEL, 1, builders.adaboost(3, 0.5))
    model = models[0]
    codes = B.bin_values(x, model.edges)
    weight = np.full(len(y), 1 / len(y))
    for tree in model.trees:
        vote = margin_of([tree], codes)
        wrong = (vote > 0) != (y == 1)
        error = weight[wrong].sum() / weight.sum()
        alpha = 0.5 * math.log((1 - error) / error)
        assert np.abs(vote) == pytest.approx(np.full(len(y), alpha))
        weight = weight * np.exp(alpha * wrong)
    p = model.probability(margin_of(model.trees, codes))
    assert p.min() >= 1 / (1 + math.e**2) - 1e-9 and p.max() <= 1 / (1 + math.e**-2) + 1e-9


def test_squared_loss_lowers_the_error(train, matrix):
    _, _, y = matrix
    models, rows = B.fit_folds(one_fold(train), FEATURES, S.TARGET, 1, builders.boosted_regression(10, 0.3))
    scored = B.score_folds(rows, models).toPandas()
    assert ((scored["margin"] - scored["y"]) ** 2).mean() < 0.9 * y.var()
    assert models[0].prior == pytest.approx(y.mean())


def test_row_sample_is_repeatable_and_of_the_right_size():
    ids = np.arange(100_000)
    a = sampled(ids, 0.7, 42, 3)
    assert np.array_equal(a[::-1], sampled(ids[::-1], 0.7, 42, 3))
    assert a.mean() == pytest.approx(0.7, abs=0.01)
    assert (a != sampled(ids, 0.7, 42, 4)).mean() > 0.3


def test_boosted_model_beats_the_majority(train, folds):
    from tidepanel.operators.baselines import evaluate_rules

    majority = {r["fold"]: r["accuracy"] for r in evaluate_rules(train, folds, ["majority"]).collect()}
    rows = evaluate.evaluate_model(train, folds, builders.level_wise_boosting(8, 0.3), FEATURES).collect()
    assert len(rows) == 4
    for r in rows:
        assert r["accuracy"] > majority[r["fold"]] and r["roc_auc"] > 0.6 and r["log_loss"] < math.log(2)


def test_spark_models_on_folds(train, folds):
    result = evaluate.evaluate_model(train, folds[-2:], builders.decision_tree(max_depth=3), FEATURES)
    rows = {r["fold"]: r for r in result.collect()}
    assert set(rows) == {1, 2} and rows[2]["train_end"] == folds[-1].train_end
    assert all(0.5 < r["accuracy"] <= 1 for r in rows.values())
    bound = builders.decision_tree(max_depth=3).on(FEATURES)
    again = {r["fold"]: r["accuracy"] for r in evaluate.evaluate_model(train, folds[-2:], bound, FEATURES).collect()}
    assert again == {f: r["accuracy"] for f, r in rows.items()}
    with pytest.raises(ValueError, match="nothing"):
        evaluate.evaluate_model(train, folds, bound, ["nothing"])
    late = [folds[0]._replace(valid_start="DATE_9998", valid_end="DATE_9999")]
    with pytest.raises(ValueError, match="no train or no validation"):
        evaluate.evaluate_model(train, late, bound, FEATURES)


def test_grid_search_ranks_and_final_check(train, folds):
    grid = {"max_depth": [1, 3], "min_samples_leaf": [10, 20]}
    build = lambda **s: builders.decision_tree(**s)
    table, final = tuning.tune_and_check(train, folds, build, grid, FEATURES)
    rows = table.collect()
    assert len(rows) == 4 and rows[0]["rank_test_accuracy"] == 1
    accuracies = [r["mean_test_accuracy"] for r in rows]
    assert accuracies == sorted(accuracies, reverse=True)
    for r in rows:
        assert r["rank_test_accuracy"] == 1 + sum(a > r["mean_test_accuracy"] for a in accuracies)
    assert final.first()["valid_end"] == folds[-1].valid_end


def test_date_cv_and_importances(train):
    from tidepanel.plans.workflows import date_cv

    plan = builders.boosted_regression(4, 0.3)
    scores, gains = date_cv(train, FEATURES, plan, n_splits=4)
    rows = scores.collect()
    assert {r["fold"] for r in rows} == {1, 2, 3, 4} and sum(r["n"] for r in rows) == train.count()
    assert all(r["accuracy"] > 0.5 for r in rows)
    top = evaluate.top_features(gains, 2).collect()
    assert len(top) == 2 and top[0]["feature"] == "RET_1" and top[0]["mean_gain"] >= top[1]["mean_gain"]


def test_tasks_of_a_pass_follow_the_rows_not_the_shuffle_partitions(spark, train):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "96")
    try:
        _, rows = B.fit_folds(one_fold(train), FEATURES, S.LABEL, 1, plain(rounds=1))
        assert rows.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_sums_added_by_reducers_give_the_same_trees(train, monkeypatch):
    plan = plain(rounds=2, growth="symmetric", max_depth=3)
    a, _ = B.fit_folds(one_fold(train), FEATURES, S.LABEL, 1, plan)
    for name, value in (("DIRECT_BYTES", 0), ("SHORT_SEGMENT", 100), ("FAN_IN", 1), ("BLOCK", 100)):
        monkeypatch.setattr(B, name, value)
    b, _ = B.fit_folds(one_fold(train), FEATURES, S.LABEL, 1, plan)
    assert [(t.feature, t.cut) for t in a[0].trees] == [(t.feature, t.cut) for t in b[0].trees]
    assert [t.value for t in a[0].trees] == [pytest.approx(t.value) for t in b[0].trees]


def test_spark_models_are_fitted_on_partitions_by_rows(spark, train, folds, monkeypatch):
    from tidepanel.models import evaluate

    seen = []

    class Counting:
        def fit(self, rows):
            seen.append(rows.rdd.getNumPartitions())
            raise RuntimeError("counted")

    monkeypatch.setattr(evaluate, "bind", lambda *_: Counting())
    with pytest.raises(RuntimeError, match="counted"):
        evaluate.scored_folds(train.repartition(96), folds, builders.spark_gradient_boosting(), FEATURES, parallelism=1)
    assert seen and max(seen) <= spark.sparkContext.defaultParallelism
