import math

import pytest

from tidepanel import schema as S
from tidepanel.functions import features as X
from tidepanel.functions.rules import class_of, rule_columns, with_rule
from tidepanel.operators.cross_section import with_date_means
from tidepanel.operators.labels import join_labels, split_target
from tidepanel.sources.files import nan_to_null


def test_no_lags_give_null(panel_rows):
    row = X.with_engineered(panel_rows([{}])).first()
    for name in [*X.MOMENTUM, *X.VOLATILITY, *X.RATIO, *X.VOLUME]:
        assert row[name] is None


def test_one_lag(panel_rows):
    row = X.with_engineered(panel_rows([{"RET_1": 0.1}])).first()
    assert row["momentum_3"] == 0.1 and row["momentum_20"] == 0.1 and row["delta_momentum_3_20"] == 0.0
    assert row["volatility_3"] is None and row["momentum_volatility_ratio_20"] is None


def test_two_lags_and_ratio(panel_rows):
    row = X.with_engineered(panel_rows([{"RET_1": 0.1, "RET_3": 0.3}])).first()
    deviation = math.sqrt(0.02)
    assert row["momentum_3"] == pytest.approx(0.2)
    assert row["volatility_3"] == pytest.approx(deviation)
    assert row["momentum_volatility_ratio_20"] == pytest.approx(0.2 / (deviation + 1e-4))


def test_constant_lags_have_zero_deviation(panel_rows):
    row = X.with_engineered(panel_rows([{c: 0.25 for c in S.RETURNS}])).first()
    assert row["volatility_20"] == 0.0
    assert row["momentum_volatility_ratio_20"] == pytest.approx(2500.0)


def test_nan_counts_as_missing(panel_rows):
    df = nan_to_null(panel_rows([{"RET_1": float("nan"), "RET_2": 0.4}]))
    row = with_rule(X.with_momentum(df), "momentum").first()
    assert row["RET_1"] is None and row["momentum_3"] == 0.4 and row["prediction"] == 0


def test_rules_on_zero_null_and_means(panel_rows):
    df = panel_rows(
        [{"RET_1": 0.0}, {}, {"RET_1": 0.1, "RET_2": -0.3}, {"RET_1": -0.1}]
    )
    rows = df.select(S.ROW_ID, *[c.alias(n) for n, c in rule_columns().items()]).orderBy(S.ROW_ID).collect()
    assert [r["momentum"] for r in rows] == [0, 0, 1, 0]
    assert [r["reversal"] for r in rows] == [0, 0, 0, 1]
    assert [r["agr_momentum"] for r in rows] == [0, 0, 0, 0]
    assert [r["agr_reversal"] for r in rows] == [0, 0, 1, 1]
    assert {(r["always_0"], r["always_1"]) for r in rows} == {(0, 1)}


def test_missing_columns_are_named(panel_rows):
    with pytest.raises(ValueError, match="RET_2"):
        X.with_momentum(panel_rows([{}]).drop("RET_2"))
    with pytest.raises(ValueError, match="momentum_3"):
        X.with_momentum_volatility_ratio(panel_rows([{}]))
    with pytest.raises(ValueError, match="RET_1"):
        with_rule(panel_rows([{}]).drop("RET_1"), "reversal")


def test_class_and_label_join(spark, panel_rows):
    labels = spark.createDataFrame([(0, 0.5), (1, 0.0), (2, None), (9, 1.0)], S.LABEL_SCHEMA)
    joined, labelled = join_labels(panel_rows([{}, {}, {}]), labels)
    assert [r[S.LABEL] for r in joined.orderBy(S.ROW_ID).collect()] == [1, 0, 0]
    assert labelled.count() == 4
    with pytest.raises(ValueError, match="target"):
        join_labels(panel_rows([{}]), labels.drop(S.TARGET))
    features, target = split_target(joined)
    assert S.TARGET not in features.columns and target.columns == [S.ROW_ID, S.TARGET]
    assert labels.select(class_of("target").alias("c")).where("c = 1").count() == 2


def test_feature_selection(panel_rows):
    df = X.with_engineered(panel_rows([{}], label=True))
    names = X.numeric_features(df)
    assert len(names) == 54 and S.GROUP in names and not set(names) & set(S.NON_FEATURES)
    assert set(names) == set(X.feature_sets()["engineered"])
    assert X.return_features(df) == S.RETURNS
    with pytest.raises(ValueError):
        X.numeric_features(df.select(S.TS))


def test_date_means_and_ts_contract(panel_rows):
    df = panel_rows(
        [{"TS": "DATE_0001", "RET_1": 1.0}, {"TS": "DATE_0001", "RET_1": 3.0}, {"TS": "DATE_0001"}, {"TS": "DATE_0002", "RET_1": 5.0}]
    )
    rows = with_date_means(df, ["RET_1"]).orderBy(S.ROW_ID).collect()
    assert [r["ALLOCATIONS_RET_1"] for r in rows] == [2.0, 2.0, 2.0, 5.0]
    free = panel_rows([{"TS": "2020-01-01", "RET_1": 1.0}])
    assert with_date_means(free, ["RET_1"], bounded=False).first()["ALLOCATIONS_RET_1"] == 1.0
    with pytest.raises(Exception, match="DATE_nnnn"):
        with_date_means(free, ["RET_1"]).collect()
