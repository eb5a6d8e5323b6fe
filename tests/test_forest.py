"""Forests that train together, against Spark's own tree, against themselves and against plain counts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel import schema as S
from tidepanel.models import builders, evaluate, forest, tuning
from tidepanel.models.forest import Forest, forest_nodes, score_forests, weights_of
from tidepanel.plans.workflows import fit_and_score

FEATURES = S.RETURNS[:6]


@pytest.fixture(scope="module")
def both_sides(train):
    return train.withColumns({"train": F.lit(1), "valid": F.lit(1)})


def scores(df):
    return {(r["plan"], r["fold"], r["ROW_ID"]): r["p1"] for r in df.collect()}


def test_one_tree_equals_the_tree_of_spark(train):
    """Few different values, so that both sides know the same cut points."""
    coarse = train.withColumns({c: F.round(F.coalesce(F.col(c), F.lit(0.0)) * 8) for c in FEATURES}).persist()
    marked = coarse.withColumns({"train": F.lit(1), "valid": F.lit(1)})
    plan = Forest(1, 5, 20, max_features=None, bootstrap=False)
    mine = scores(score_forests(marked, FEATURES, S.LABEL, 1, [plan]))
    fitted = builders.decision_tree(max_depth=5, min_samples_leaf=20).on(FEATURES).fit(coarse)
    theirs = {r[S.ROW_ID]: r["p1"] for r in evaluate.with_probability(fitted.transform(coarse)).collect()}
    assert len(mine) == len(theirs) and len(set(theirs.values())) > 8
    leaves = {}
    for (_, _, row), p in mine.items():
        leaves.setdefault(theirs[row], []).append(p)
    for share, inside in leaves.items():  # Spark joins neighbouring leaves that predict the same class
        assert np.mean(inside) == pytest.approx(share, abs=1e-9)
        assert len({p > 0.5 for p in inside}) == 1 and (inside[0] > 0.5) == (share > 0.5)


def test_large_nodes_split_by_jobs_equal_nodes_split_in_tasks(both_sides, monkeypatch):
    plans = [Forest(3, 7, 10, max_features="sqrt", seed=5), Forest(2, None, 30, 70, 0.5, False, "balanced", seed=6)]
    whole = scores(score_forests(both_sides, FEATURES, S.LABEL, 1, plans))
    nodes = {tuple(r) for r in forest_nodes(both_sides, FEATURES, S.LABEL, 1, plans).drop("gain").collect()}
    monkeypatch.setattr(forest, "LOCAL_ROWS", 400)
    monkeypatch.setattr(forest, "CELLS", 2000)
    monkeypatch.setattr(forest, "TREES_PER_TASK", 1)
    assert scores(score_forests(both_sides, FEATURES, S.LABEL, 1, plans)) == whole
    assert {tuple(r) for r in forest_nodes(both_sides, FEATURES, S.LABEL, 1, plans).drop("gain").collect()} == nodes


def test_nodes_add_up(both_sides):
    plan = Forest(4, 6, 15)
    rows = forest_nodes(both_sides, FEATURES, S.LABEL, 1, [plan]).collect()
    nodes = {(r["tree"], r["node"]): r for r in rows}
    assert {t for t, _ in nodes} == set(range(4)) and len(nodes) == len(rows)
    for (tree, node), r in nodes.items():
        if r["feature"] < 0:
            assert (tree, 2 * node) not in nodes
            continue
        left, right = nodes[tree, 2 * node], nodes[tree, 2 * node + 1]
        assert left["n"] + right["n"] == r["n"] and left["weight"] + right["weight"] == r["weight"]
        assert min(left["n"], right["n"]) >= 15 and node < 2**6 and r["gain"] > 0
        ones = left["p1"] * left["weight"] + right["p1"] * right["weight"]
        assert ones == pytest.approx(r["p1"] * r["weight"])


def test_bootstrap_weights():
    plan, ids = Forest(2), np.arange(200_000)
    w = weights_of(ids, plan, 0, 0)
    assert w.mean() == pytest.approx(1, abs=0.01) and w.var() == pytest.approx(1, abs=0.02)
    assert (w == 0).mean() == pytest.approx(np.exp(-1), abs=0.005)
    assert np.array_equal(w[::-1], weights_of(ids[::-1], plan, 0, 0)) and not np.array_equal(w, weights_of(ids, plan, 0, 1))
    assert (weights_of(ids, plan.with_settings(bootstrap=False), 0, 0) == 1).all()


def test_features_are_drawn_per_node():
    plan, nodes = Forest(max_features=3), np.arange(1, 2000)
    tried = forest.tried_features(plan, 0, 0, nodes, 10)
    assert tried.shape == (1999, 3) and (np.diff(tried, axis=1) > 0).all()
    assert np.bincount(tried.ravel(), minlength=10).min() > 500
    assert np.array_equal(tried[7:8], forest.tried_features(plan, 0, 0, nodes[7:8], 10))


def test_class_weights_move_the_votes(both_sides):
    plans = [Forest(5, 4, class_weight=w) for w in (None, {0: 1.0, 1: 50.0}, "balanced")]
    means = {p: [] for p in range(3)}
    for (plan, _, _), p1 in scores(score_forests(both_sides, FEATURES, S.LABEL, 1, plans)).items():
        means[plan].append(p1)
    assert np.mean(means[1]) > 0.9 > np.mean(means[0]) and np.mean(means[2]) == pytest.approx(0.5, abs=0.05)


def test_grid_of_forests_equals_forests_alone(train, folds):
    grid = {"max_depth": [2, 4], "min_samples_leaf": [10]}
    build = lambda **s: builders.random_forest(n_estimators=5, **s)
    table = tuning.grid_scores(train, folds[:2], build, grid, FEATURES).collect()
    assert {(r["candidate"], r["fold"]) for r in table} == {(c, f.fold) for c in (0, 1) for f in folds[:2]}
    alone = {r["fold"]: r for r in evaluate.evaluate_model(train, folds[:2], build(max_depth=4, min_samples_leaf=10), FEATURES).collect()}
    for r in table:
        assert r["fit_time"] > 0 and 0.5 < r["train_accuracy"] <= 1
        if r["candidate"] == 1:
            assert r["test_accuracy"] == alone[r["fold"]]["accuracy"] and r["roc_auc"] == pytest.approx(alone[r["fold"]]["roc_auc"])
            assert alone[r["fold"]]["roc_auc"] > 0.6


def test_forest_scores_a_table_without_labels(train):
    fit, rest = train.where("ROW_ID % 3 <> 0"), train.where("ROW_ID % 3 = 0").drop(S.LABEL)
    found = fit_and_score(fit, rest, builders.random_forest(n_estimators=6), FEATURES)
    assert found.count() == rest.count()
    truth = train.select(S.ROW_ID, S.LABEL)
    assert found.join(truth, S.ROW_ID).where(F.col(S.PREDICTION) == F.col(S.LABEL)).count() > 0.55 * rest.count()


def test_one_class_and_bad_settings(both_sides):
    one = both_sides.withColumn(S.LABEL, F.lit(1))
    assert set(scores(score_forests(one, FEATURES, S.LABEL, 1, [Forest(2, 3)])).values()) == {1.0}
    with pytest.raises(ValueError):
        score_forests(both_sides.withColumn("train", F.lit(0)), FEATURES, S.LABEL, 1, [Forest(2)])
    with pytest.raises(ValueError):
        score_forests(both_sides, FEATURES, S.LABEL, 1, [Forest(2), Forest(2, bins=32)])
    with pytest.raises(ValueError):
        builders.random_forest(min_samples_split=1)
