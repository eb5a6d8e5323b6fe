import pytest
from pyspark.sql import functions as F

from conftest import ROOT
from tidepanel import schema as S
from tidepanel.models import builders
from tidepanel.operators import quality
from tidepanel.plans import catalog, workflows
from tidepanel.sources import brand_days, files


def submission(spark, rows):
    return spark.createDataFrame(rows, "ROW_ID long, prediction int")


BAD = [
    ([(1, 0), (1, 1)], "repeats ids"),
    ([(1, 0)], "lacks ids"),
    ([(1, 0), (2, 1), (3, 1)], "unknown ids"),
    ([(1, 0), (2, 2)], "0 or 1"),
    ([(1, 0), (2, None)], "NULL predictions"),
    ([(1, 0), (None, 1)], "NULL ids"),
]


@pytest.mark.parametrize("rows,message", BAD)
def test_bad_submissions_are_refused(spark, rows, message):
    expected = spark.createDataFrame([(1,), (2,)], "ROW_ID long")
    with pytest.raises(ValueError, match=message):
        quality.check_submission(submission(spark, rows), expected)


def test_good_submission_and_columns(spark):
    expected = spark.createDataFrame([(1,), (2,)], "ROW_ID long")
    good = submission(spark, [(2, 0), (1, 1)])
    quality.check_submission(good, expected)
    assert quality.submission_report(good, expected).first()["ok"]
    with pytest.raises(ValueError, match="columns"):
        quality.check_submission(good.withColumn("x", F.lit(1)), expected)


def test_feature_checks(spark):
    df = spark.createDataFrame([(1.0, float("inf"))], "a double, b double")
    quality.check_features(df, df, ["a"])
    with pytest.raises(ValueError, match="infinite"):
        quality.check_features(df, df, ["a", "b"])
    with pytest.raises(ValueError, match="twice"):
        quality.check_features(df, df, ["a", "a"])
    with pytest.raises(ValueError, match="test features"):
        quality.check_features(df, df.drop("b"), ["a", "b"])


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("panel"))
    panel = brand_days.brand_day_panel(spark, ROOT)
    fit, rows = brand_days.train_panel(panel), brand_days.test_panel(panel)
    named = [f.name for f in S.PANEL_SCHEMA]
    tables = {
        files.TRAIN_FEATURES: fit.select(*named),
        files.TEST_FEATURES: rows.select(*named),
        files.TRAIN_LABELS: fit.select(S.ROW_ID, S.TARGET),
        files.KEY_TEMPLATE: rows.select(S.ROW_ID, F.lit(0).alias(S.PREDICTION)),
    }
    for name, df in tables.items():
        df.coalesce(1).write.option("header", True).option("nullValue", "").csv(f"{root}/{name}.csv")
    return root


def test_csv_round_trip(spark, folder, train):
    source = files.PanelFiles(spark, folder)
    read = source.train_features()
    assert read.schema.simpleString() == S.PANEL_SCHEMA.simpleString()
    assert read.count() == train.count()
    assert read.exceptAll(train.select(read.columns)).count() == 0
    assert source.key_template().columns == [S.ROW_ID]
    assert source.test_features().count() == source.key_template().count() == 301


def test_malformed_csv_fails(spark, tmp_path):
    (tmp_path / "y_train.csv").write_text("ROW_ID,target\n1,0.5\n2,abc\n")
    with pytest.raises(Exception, match="(?i)malformed|cannot|invalid"):
        files.PanelFiles(spark, str(tmp_path)).train_labels().collect()
    (tmp_path / "X_train.csv").write_text("ROW_ID\n1\n")
    with pytest.raises(ValueError, match="missing columns"):
        files.PanelFiles(spark, str(tmp_path)).train_features()


@pytest.mark.parametrize("model", [builders.level_wise_boosting(3), builders.decision_tree()])
def test_whole_submission(spark, folder, tmp_path, model):
    out = str(tmp_path / "predictions.csv")
    report = workflows.run_submission(files.PanelFiles(spark, folder), model, out).first()
    assert report["n_rows"] == 301 and report["n_null"] == 0 and report["path"] == out
    written = spark.read.option("header", True).csv(out)
    assert written.columns == [S.ROW_ID, S.PREDICTION] and written.count() == 301
    assert written.agg(F.sum(S.PREDICTION)).first()[0] == report["n_positive"]


def test_file_names(spark, tmp_path):
    df = submission(spark, [(1, 0)])
    with pytest.raises(ValueError, match=".csv"):
        files.write_predictions(df, str(tmp_path / "x.txt"))
    files.write_predictions(df, str(tmp_path / "x.CSV"), single_file=True)
    scores = spark.createDataFrame([(1, -0.5), (2, 0.5), (3, 0.0)], "ROW_ID long, score double")
    files.write_sign_predictions(scores, "score", str(tmp_path / "s.csv"))
    rows = spark.read.option("header", True).csv(str(tmp_path / "s.csv")).collect()
    assert {(r[0], r[1]) for r in rows} == {("1", "0"), ("2", "1"), ("3", "0")}


def test_parquet_panel_is_pruned_by_date(spark, tmp_path, train):
    path = files.write_panel(train, str(tmp_path / "panel.parquet"), files=4)
    back = files.read_table(spark, path)
    assert back.count() == train.count()
    plan = back.where("TS <= 'DATE_0010'").select("RET_1")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "LessThanOrEqual(TS,DATE_0010)" in plan and "RET_2" not in plan


def test_reports(spark, train, folds):
    panel = brand_days.brand_day_panel(spark, ROOT)
    rows = {(r["check"], r["subject"], r["column"]): r["value"] for r in catalog.q_audit_report(spark, ROOT).collect()}
    assert rows["rows", "test", S.ROW_ID] == 301 and rows["same columns", "train and test", "*"] == 1
    assert rows["aligned keys", "train and labels", S.ROW_ID] == 1
    tables = workflows.profile_report(train, brand_days.test_panel(panel), ["RET_1"])
    assert tables["class_share"].count() == 2 and tables["density_RET_1"].count() == 200
    results, side_by_side, summary = workflows.baseline_study(train, folds)
    assert results.count() == 28 and side_by_side.count() == 4 and summary.count() == 7


def test_feature_study(train, folds):
    sets = {"raw": S.RETURNS[:3], "ratio": ["momentum_volatility_ratio_20"]}
    rows = {r["feature_set"]: r for r in workflows.feature_study(train, folds[-2:], builders.decision_tree(3), sets).collect()}
    assert rows["raw"]["decision"] == "reference" and rows["raw"]["folds_ahead"] is None
    assert rows["ratio"]["decision"] in ("keep", "reject") and rows["ratio"]["n_features"] == 1


def test_benchmark_study(spark):
    panel = brand_days.brand_day_panel(spark, ROOT)
    found = workflows.benchmark_study(brand_days.train_panel(panel), brand_days.test_panel(panel), boosted=builders.boosted_regression(3, 0.3), n_splits=3)
    assert found["ridge"].count() == found["boosted"].count() == 301
    assert found["cv_scores"].count() == 3 and found["top_features"].count() == 20
    band = found["cv_band"].first()
    assert band["lower_pct"] <= band["mean_pct"] <= band["upper_pct"]


def test_order_of_written_ids(spark, tmp_path):
    from tidepanel.operators.quality import check_order, order_report
    from tidepanel.sources.files import file_positions, write_predictions

    ids = [(i * 7919) % 5000 for i in range(5000)]
    template, out = str(tmp_path / "template.csv"), str(tmp_path / "out.csv")
    spark.createDataFrame([(i,) for i in ids], "ROW_ID long").coalesce(3).write.option("header", True).csv(template)
    found = {r["position"]: r["ROW_ID"] for r in file_positions(spark, template).collect()}
    assert [found[p] for p in range(5000)] == ids
    predicted = spark.range(5000).select(F.col("id").alias("ROW_ID"), F.lit(1).alias("prediction")).repartition(4)
    write_predictions(predicted, out, like=template)
    check_order(file_positions(spark, out), file_positions(spark, template))
    moved = str(tmp_path / "moved")
    spark.createDataFrame([(i,) for i in [ids[1], ids[0], *ids[2:4999]]], "ROW_ID long").coalesce(1).write.parquet(moved)
    row = order_report(file_positions(spark, moved), file_positions(spark, template)).first()
    assert tuple(row) == (4999, 5000, 3, False)
    with pytest.raises(ValueError, match="order"):
        check_order(file_positions(spark, moved), file_positions(spark, template))
    with pytest.raises(Exception, match="ids that are not in"):
        write_predictions(predicted.withColumn("ROW_ID", F.col("ROW_ID") + 1), out, like=template)
