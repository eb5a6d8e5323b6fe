import pytest

from tidepanel import schema as S
from tidepanel.operators import time_axis as axis


def names(n):
    return [f"DATE_{i:04d}" for i in range(1, n + 1)]


def test_fold_bounds(spark):
    folds = axis.collect_folds(axis.expanding_fold_table(axis.axis_of_dates(spark, names(10)[::-1]), size=2, k=3))
    assert folds == [
        axis.Fold(1, "DATE_0001", "DATE_0004", "DATE_0005", "DATE_0006"),
        axis.Fold(2, "DATE_0001", "DATE_0006", "DATE_0007", "DATE_0008"),
        axis.Fold(3, "DATE_0001", "DATE_0008", "DATE_0009", "DATE_0010"),
    ]


def test_fold_size_limits(spark):
    with pytest.raises(Exception, match="more than 480 dates"):
        axis.collect_folds(axis.expanding_fold_table(axis.axis_of_dates(spark, names(480))))
    folds = axis.collect_folds(axis.expanding_fold_table(axis.axis_of_dates(spark, names(481))))
    assert folds[0].train_start == folds[0].train_end == "DATE_0001"
    assert folds[-1].valid_end == "DATE_0481"


@pytest.mark.parametrize("size,k", [(0, 4), (-1, 4), (120, 0)])
def test_fold_arguments(spark, size, k):
    with pytest.raises(ValueError):
        axis.expanding_fold_table(axis.axis_of_dates(spark, names(10)), size, k)


def test_date_list_checks(spark):
    with pytest.raises(ValueError, match="duplicates"):
        axis.axis_of_dates(spark, ["DATE_0001", "DATE_0001"])
    with pytest.raises(ValueError, match="empty"):
        axis.axis_of_dates(spark, [])


def test_roles_by_position_and_by_bounds_agree(spark):
    dates = axis.axis_of_dates(spark, names(23))
    folds = axis.collect_folds(axis.expanding_fold_table(dates, 3, 4))
    by_bounds = {tuple(r) for r in axis.explode_roles(dates.select(S.TS), folds).collect()}
    by_position = {tuple(r) for r in axis.expanding_roles(dates, 3, 4).select(S.TS, "fold", "side").collect()}
    assert by_bounds == by_position
    brute = {
        (d, f.fold, side)
        for d in names(23) for f in folds
        for side, a, b in (("train", f.train_start, f.train_end), ("valid", f.valid_start, f.valid_end)) if a <= d <= b
    }
    assert by_bounds == brute


def test_fold_checks(spark):
    dates = axis.axis_of_dates(spark, names(10))
    good = axis.collect_folds(axis.expanding_fold_table(dates, 2, 3))
    assert axis.check_folds(dates, good, 2)
    with pytest.raises(ValueError, match="instead of 3"):
        axis.check_folds(dates, good, 3)
    leak = [axis.Fold(1, "DATE_0001", "DATE_0005", "DATE_0005", "DATE_0006")]
    with pytest.raises(ValueError, match="strictly before"):
        axis.check_folds(dates, leak, 2)
    empty = [axis.Fold(1, "DATE_0001", "DATE_0005", "DATE_0100", "DATE_0101")]
    with pytest.raises(ValueError, match="empty side"):
        axis.check_folds(dates, empty, 2)


def test_fold_list_checks():
    with pytest.raises(ValueError):
        axis.check_fold_list([])
    with pytest.raises(KeyError):
        axis.check_fold_list([{"train_start": "DATE_0001"}])
    bounds = dict(train_start="a", train_end="b", valid_start="c", valid_end="d")
    assert axis.check_fold_list([bounds])[0].fold == 1


def test_tuning_split_keeps_the_last_fold(train, folds):
    tuning, last = axis.tuning_split(folds)
    assert last == folds[-1] and len(tuning) == 3
    assert axis.axis_bounds(axis.tuning_rows(train, folds)).first()["last_date"] == tuning[-1].valid_end
    with pytest.raises(ValueError):
        axis.tuning_split(folds[:1])


def test_date_kfold_is_balanced_and_repeatable(spark):
    dates = axis.axis_of_dates(spark, names(83))
    a = {r[S.TS]: r["fold"] for r in axis.date_kfold(dates, 8, seed=0).collect()}
    assert a == {r[S.TS]: r["fold"] for r in axis.date_kfold(dates.repartition(5), 8, seed=0).collect()}
    sizes = [list(a.values()).count(f) for f in range(8)]
    assert sorted(sizes) == [10] * 5 + [11] * 3
    assert a != {r[S.TS]: r["fold"] for r in axis.date_kfold(dates, 8, seed=1).collect()}


def test_continuity(spark, panel_rows):
    gap = panel_rows([{"TS": "DATE_0001"}, {"TS": "DATE_0003"}])
    assert axis.axis_continuity(gap).first()["continuous"] is False


def test_rows_on_dates_and_shared_dates(panel_rows):
    df = panel_rows([{"TS": "DATE_0001"}, {"TS": "DATE_0002"}, {"TS": "DATE_0002"}])
    picked = axis.rows_on_dates(df, df.where("TS = 'DATE_0002'"))
    assert picked.count() == 2
    assert [r[0] for r in axis.shared_dates(df, picked).collect()] == ["DATE_0002"]
