import math
import random

import pytest

from tidepanel import schema as S
from tidepanel.operators import metrics
from tidepanel.operators.baselines import evaluate_custom, evaluate_rules
from tidepanel.operators.compare import compare_results, folds_ahead, numeric_means


def scored(spark, rows):
    return spark.createDataFrame(rows, "fold int, class int, prediction int, p1 double")


def brute_auc(pairs):
    pos = [p for y, p in pairs if y == 1]
    neg = [p for y, p in pairs if y == 0]
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("bins", [1, 7, 65_536])
def test_auc_against_all_pairs(spark, bins):
    rng = random.Random(3)
    rows = []
    for fold in (1, 2):
        for _ in range(400):
            y = rng.random() < 0.4
            p = float(round(min(max(rng.gauss(0.45 + 0.1 * y, 0.2), 0), 1), 2 if fold == 1 else 9))
            rows.append((fold, int(y), int(p > 0.5), p))
    # a third of one fold shares a single score
    rows += [(1, i % 2, 0, 0.41) for i in range(400)]
    got = {r["fold"]: r for r in metrics.score_metrics(scored(spark, rows), bins=bins).collect()}
    for fold in (1, 2):
        mine = [(y, p) for f, y, _, p in rows if f == fold]
        assert got[fold]["roc_auc"] == pytest.approx(brute_auc(mine), abs=1e-12)
        loss = sum(-math.log(p if y else 1 - p) if 0 < p < 1 else (0 if (p == 1) == bool(y) else -math.log(metrics.CLIP)) for y, p in mine)
        assert got[fold]["log_loss"] == pytest.approx(loss / len(mine), rel=1e-9)
        hits = sum(1 for f, y, pred, _ in rows if f == fold and y == pred)
        assert got[fold]["n_correct_predictions"] == hits and got[fold]["n_valid_predictions"] == len(mine)


def test_one_class_and_constant_scores(spark):
    rows = [(1, 1, 1, 0.9), (1, 1, 0, 0.2), (2, 1, 0, 0.5), (2, 0, 0, 0.5), (3, 1, 1, 1.0), (3, 0, 1, 1.0)]
    got = {r["fold"]: r for r in metrics.score_metrics(scored(spark, rows)).collect()}
    assert got[1]["roc_auc"] is None and got[1]["log_loss"] > 0
    assert got[2]["roc_auc"] == 0.5 and got[2]["log_loss"] == pytest.approx(math.log(2))
    assert math.isfinite(got[3]["log_loss"]) and got[3]["log_loss"] == pytest.approx(-math.log(metrics.CLIP) / 2, rel=1e-6)


def days(pattern, start=1):
    """One row per entry: (date number, class, RET_1)."""
    return [
        {"TS": f"DATE_{d:04d}", S.LABEL: c, S.TARGET: float(c), "RET_1": r, "ALLOCATION": "a"} for d, c, r in pattern
    ]


def test_majority_tie_predicts_one(panel_rows):
    df = panel_rows(days([(1, 0, 0.1), (1, 1, 0.1), (2, 1, -0.1), (3, 0, 0.2)]), label=True)
    rows = {(r["strategy"], r["fold"]): r for r in evaluate_rules(df, size=1, k=2).collect()}
    assert rows["majority", 1]["accuracy"] == 1.0  # 1:1 tie -> 1, truth 1
    assert rows["majority", 2]["accuracy"] == 0.0  # 2:1 -> 1, truth 0
    assert rows["reversal", 1]["n_correct_predictions"] == 1
    assert rows["momentum", 2]["n_correct_predictions"] == 0
    assert rows["always_0", 2]["valid_positive_rate"] == 0.0


def test_explicit_folds_equal_positions(train, folds):
    a = sorted(map(tuple, evaluate_rules(train).collect()))
    b = sorted(map(tuple, evaluate_rules(train, folds).collect()))
    assert a == b


def test_rule_guards(train, folds):
    from pyspark.sql import functions as F

    with pytest.raises(ValueError, match="RET_2"):
        evaluate_rules(train.drop("RET_2"))
    with pytest.raises(Exception, match="0 or 1"):
        evaluate_rules(train, rules={"bad": F.lit(2)}).collect()
    late = [f._replace(valid_start="DATE_9998", valid_end="DATE_9999") for f in folds]
    with pytest.raises(Exception, match="no train or no validation"):
        evaluate_rules(train, late).collect()


def test_custom_function_matches_rule(train, folds):
    from tidepanel.functions.rules import with_rule

    mine = evaluate_custom(train, folds[:2], lambda fit, valid: with_rule(valid, "reversal"))
    rule = evaluate_rules(train, folds[:2], ["reversal"]).drop("strategy")
    assert sorted(map(tuple, mine.select(rule.columns).collect())) == sorted(map(tuple, rule.collect()))
    with pytest.raises(ValueError, match="lost rows"):
        evaluate_custom(train, folds[:1], lambda fit, valid: with_rule(valid, "reversal").where("RET_1 > 0"))


def test_compare(spark):
    schema = "fold int, accuracy double, log_loss double, roc_auc double"
    a = spark.createDataFrame([(1, 0.5, 0.7, 0.5), (2, 0.6, 0.6, None)], schema)
    b = spark.createDataFrame([(1, 0.6, 0.6, 0.7), (2, 0.5, 0.65, 0.6), (3, 1.0, 0.1, 1.0)], schema)
    table = compare_results(a, b, "raw", "new").orderBy("fold")
    rows = table.collect()
    assert len(rows) == 2 and rows[0]["delta_accuracy"] == pytest.approx(0.1) and rows[1]["delta_roc_auc"] is None
    assert rows[0]["accuracy_raw"] == 0.5 and rows[0]["accuracy_new"] == 0.6
    assert tuple(folds_ahead(table).first()) == (1, 2)
    assert numeric_means(table).first()["delta_roc_auc"] == pytest.approx(0.2)
    with pytest.raises(ValueError, match="roc_auc"):
        compare_results(a.drop("roc_auc"), b)
