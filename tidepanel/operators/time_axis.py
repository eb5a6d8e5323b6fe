"""The date axis, expanding-window folds and other date splits.

All of this works on distinct dates (at most 10,000).  Panel rows get their
folds by comparing TS with the k fold bounds: a projection, no join.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepanel import schema as S
from tidepanel.operators.per_date import checked_ts, join_per_date

TRAIN, VALID = "train", "valid"


class Fold(NamedTuple):
    """Inclusive date bounds of one train and validation period."""

    fold: int
    train_start: str
    train_end: str
    valid_start: str
    valid_end: str


FOLD_KEYS = Fold._fields
FOLD_SCHEMA = "fold int, train_start string, train_end string, valid_start string, valid_end string"


# ---- axis ------------------------------------------------------------------

def number_dates(dates: DataFrame) -> DataFrame:
    """Add ``date_idx`` (from 1) and ``n_dates`` to a table with one row per date.

    The unpartitioned window sees dates only, never panel rows; their number is
    bounded by the TS format, which is enforced here.
    """
    order = Window.orderBy(S.TS)
    return (
        dates.withColumn(S.TS, checked_ts())
        .withColumn("date_idx", F.row_number().over(order))
        .withColumn("n_dates", F.count("*").over(Window.partitionBy()).cast("int"))
    )


def date_axis(df: DataFrame) -> DataFrame:
    """Sorted distinct dates with their position."""
    S.require_columns(df, [S.TS], "date axis")
    return number_dates(df.select(S.TS).where(F.col(S.TS).isNotNull()).distinct())


def axis_of_dates(spark: SparkSession, dates: Sequence[str]) -> DataFrame:
    """Axis of a date list that the caller already holds; duplicates are refused."""
    if not dates:
        raise ValueError("the date list is empty")
    if len(set(dates)) < len(dates):
        raise ValueError("the date list has duplicates")
    return number_dates(spark.createDataFrame([(d,) for d in dates], "TS string"))


def axis_bounds(df: DataFrame) -> DataFrame:
    """First and last date, without a sort."""
    return df.agg(F.min(S.TS).alias("first_date"), F.max(S.TS).alias("last_date"))


def axis_continuity(df: DataFrame) -> DataFrame:
    """Does every number between the first and the last date occur?"""
    number = F.substring_index(S.TS, "_", -1).cast("int")
    found = df.select(S.TS).distinct().agg(
        F.count(S.TS).alias("n_dates"), F.min(number).alias("first_no"), F.max(number).alias("last_no")
    )
    return found.withColumn("continuous", F.col("n_dates") == F.col("last_no") - F.col("first_no") + 1)


# ---- expanding-window folds ------------------------------------------------

def _check_arguments(size: int, k: int) -> None:
    if size <= 0 or k <= 0:
        raise ValueError("fold size and number of folds must be positive")


def _enough_dates(axis: DataFrame, size: int, k: int) -> DataFrame:
    message = f"{k} folds of {size} dates need more than {k * size} dates"
    guarded = F.when(F.col("n_dates") > k * size, F.col("n_dates")).otherwise(
        F.raise_error(F.lit(message)).cast("int")
    )
    return axis.withColumn("n_dates", guarded)


def expanding_fold_table(axis: DataFrame, size: int = S.FOLD_SIZE, k: int = S.FOLD_COUNT) -> DataFrame:
    """k rows: the last ``size`` dates validate fold k, the block before fold k-1, ...

    Training always starts at the first date and ends just before validation.
    """
    _check_arguments(size, k)
    order = Window.orderBy(S.TS)
    placed = _enough_dates(axis, size, k).select(
        S.TS,
        "date_idx",
        (F.lit(k) - F.floor((F.col("n_dates") - F.col("date_idx")) / F.lit(size))).cast("int").alias("fold"),
        F.lag(S.TS).over(order).alias("previous"),
        F.min(S.TS).over(order).alias("first"),
    )
    return (
        placed.where("fold >= 1")
        .groupBy("fold")
        .agg(
            F.min("first").alias("train_start"),
            F.min_by("previous", "date_idx").alias("train_end"),
            F.min(S.TS).alias("valid_start"),
            F.max(S.TS).alias("valid_end"),
        )
    )


def collect_folds(table: DataFrame) -> list[Fold]:
    """The k fold rows as literals for filters (k is small by its definition)."""
    S.require_columns(table, FOLD_KEYS, "fold table")
    rows = table.select(*FOLD_KEYS).orderBy("fold").collect()
    return check_fold_list([Fold(*r) for r in rows])


def expanding_folds(df: DataFrame, size: int = S.FOLD_SIZE, k: int = S.FOLD_COUNT) -> list[Fold]:
    """Folds of a panel; one job over its TS column."""
    return collect_folds(expanding_fold_table(date_axis(df), size, k))


def check_fold_list(folds) -> list[Fold]:
    """Refuse an empty list and incomplete folds; mappings are accepted."""
    folds = list(folds)
    if not folds:
        raise ValueError("the fold list is empty")
    checked = []
    for position, fold in enumerate(folds, start=1):
        if isinstance(fold, Fold):
            checked.append(fold)
            continue
        absent = [key for key in FOLD_KEYS[1:] if key not in fold]
        if absent:
            raise KeyError(f"fold {position} lacks {absent}")
        checked.append(Fold(fold.get("fold", position), *[fold[key] for key in FOLD_KEYS[1:]]))
    return checked


def fold_table(spark: SparkSession, folds: Sequence[Fold]) -> DataFrame:
    return spark.createDataFrame([tuple(f) for f in check_fold_list(folds)], FOLD_SCHEMA)


# ---- roles of dates and rows -----------------------------------------------

def explode_roles(df: DataFrame, folds: Sequence[Fold]) -> DataFrame:
    """One output row per (fold, side) that contains the row's TS.

    Expanding train periods overlap, so train rows multiply; apply it to
    per-date aggregates where possible and to wide rows only for validation.
    """
    roles = []
    for f in check_fold_list(folds):
        for side, start, end in ((TRAIN, f.train_start, f.train_end), (VALID, f.valid_start, f.valid_end)):
            role = F.struct(F.lit(f.fold).alias("fold"), F.lit(side).alias("side"))
            roles.append(F.when(F.col(S.TS).between(start, end), role))
    tagged = df.withColumn("__role", F.explode(F.array_compact(F.array(*roles))))
    return tagged.select(*df.columns, F.col("__role.fold").alias("fold"), F.col("__role.side").alias("side"))


def expanding_roles(axis: DataFrame, size: int = S.FOLD_SIZE, k: int = S.FOLD_COUNT) -> DataFrame:
    """The same for expanding folds straight from positions: no bounds needed beforehand.

    ``axis`` carries date_idx and n_dates and may carry per-date aggregates.
    """
    _check_arguments(size, k)
    axis = _enough_dates(axis, size, k)
    from_end = F.col("n_dates") - F.col("date_idx")
    valid = F.lit(k) - F.floor(from_end / F.lit(size)).cast("int")
    # fold f trains on the dates before its validation block, f > valid
    first_train = F.greatest(valid + 1, F.lit(1))
    trains = F.when(first_train <= k, F.sequence(first_train, F.lit(k))).otherwise(F.array().cast("array<int>"))
    train_roles = F.transform(trains, lambda f: F.struct(f.alias("fold"), F.lit(TRAIN).alias("side")))
    valid_role = F.when(valid >= 1, F.struct(valid.alias("fold"), F.lit(VALID).alias("side")))
    roles = F.concat(train_roles, F.array_compact(F.array(valid_role)))
    tagged = axis.withColumn("__role", F.explode(roles))
    return tagged.select(*axis.columns, F.col("__role.fold").alias("fold"), F.col("__role.side").alias("side"))


def assign_folds(df: DataFrame, folds: Sequence[Fold], side: str | None = None) -> DataFrame:
    """Panel rows with their (fold, side); ``side`` keeps one of them.

    The date bounds are literals, so the scan is filtered by TS as well.
    """
    folds = check_fold_list(folds)
    if side == VALID:
        df = df.where(F.col(S.TS).between(min(f.valid_start for f in folds), max(f.valid_end for f in folds)))
    tagged = explode_roles(df, folds)
    return tagged.where(F.col("side") == side) if side else tagged


def split_fold(df: DataFrame, fold: Fold) -> tuple[DataFrame, DataFrame]:
    """(train rows, validation rows) of one fold, as scan-level filters."""
    return (
        df.where(F.col(S.TS).between(fold.train_start, fold.train_end)),
        df.where(F.col(S.TS).between(fold.valid_start, fold.valid_end)),
    )


def fold_checks(axis: DataFrame, folds: Sequence[Fold], size: int = S.FOLD_SIZE) -> DataFrame:
    """One row per fold with every consistency criterion and ``ok``."""
    per_date = explode_roles(axis.select(S.TS), folds)
    twice = per_date.groupBy("fold", S.TS).agg(F.count_distinct("side").alias("sides"))
    shared = twice.groupBy("fold").agg(F.count_if(F.col("sides") > 1).alias("n_shared"))
    is_train, is_valid = F.col("side") == TRAIN, F.col("side") == VALID
    sides = per_date.groupBy("fold").agg(
        F.count_if(is_train).alias("n_train_dates"),
        F.count_if(is_valid).alias("n_valid_dates"),
        F.max(F.when(is_train, F.col(S.TS))).alias("last_train"),
        F.min(F.when(is_valid, F.col(S.TS))).alias("first_valid"),
    )
    table = fold_table(axis.sparkSession, folds).select("fold")
    joined = table.join(sides, "fold", "left").join(shared, "fold", "left").fillna(
        0, ["n_train_dates", "n_valid_dates", "n_shared"]
    )
    ok = (
        (F.col("n_train_dates") > 0)
        & (F.col("n_valid_dates") == size)
        & (F.col("n_shared") == 0)
        & F.coalesce(F.col("last_train") < F.col("first_valid"), F.lit(False))
    )
    return joined.withColumn("ok", ok)


def check_folds(axis: DataFrame, folds: Sequence[Fold], size: int = S.FOLD_SIZE) -> bool:
    """True, or ValueError naming the first faulty fold."""
    bad = fold_checks(axis, folds, size).where(~F.col("ok")).orderBy("fold").first()
    if bad is None:
        return True
    if bad["n_train_dates"] == 0 or bad["n_valid_dates"] == 0:
        reason = "has an empty side"
    elif bad["n_shared"] or bad["last_train"] >= bad["first_valid"]:
        reason = "does not train strictly before it validates"
    else:
        reason = f"validates on {bad['n_valid_dates']} dates instead of {size}"
    raise ValueError(f"fold {bad['fold']} {reason}")


def fold_stats(df: DataFrame, size: int = S.FOLD_SIZE, k: int = S.FOLD_COUNT) -> DataFrame:
    """Dates, rows and percent of class 1 per fold and side: one pass, then dates only."""
    S.require_columns(df, [S.TS, S.LABEL], "fold statistics")
    per_date = df.groupBy(S.TS).agg(F.count("*").alias("n"), F.sum(S.LABEL).alias("n_pos"))
    roles = expanding_roles(number_dates(per_date), size, k)
    return roles.groupBy("fold", "side").agg(
        F.count("*").alias("n_dates"),
        F.sum("n").alias("n_rows"),
        (F.sum("n_pos") / F.sum("n") * 100).alias("pct_class_1"),
    )


# ---- other splits ----------------------------------------------------------

def with_holdout(df: DataFrame, n: int = S.FOLD_SIZE, bounded: bool = True) -> DataFrame:
    """Add ``side``: the last n dates are ``valid``, the rest ``train``."""
    last = date_axis(df).select(S.TS, F.when(F.col("date_idx") > F.col("n_dates") - n, VALID).otherwise(TRAIN).alias("side"))
    return join_per_date(df, last, "inner", bounded)


def holdout_report(df: DataFrame, n: int = S.FOLD_SIZE) -> DataFrame:
    """Sizes, bounds and class share of the last-n-dates split, per side."""
    per_date = df.groupBy(S.TS).agg(F.count("*").alias("n"), F.sum(S.LABEL).alias("n_pos"))
    side = F.when(F.col("date_idx") > F.col("n_dates") - n, VALID).otherwise(TRAIN)
    return (
        number_dates(per_date)
        .withColumn("side", side)
        .groupBy("side")
        .agg(
            F.count("*").alias("n_side_dates"),
            F.min(S.TS).alias("first_date"),
            F.max(S.TS).alias("last_date"),
            F.sum("n").alias("n_rows"),
            (F.sum("n_pos") / F.sum("n") * 100).alias("pct_class_1"),
        )
    )


def shared_dates(a: DataFrame, b: DataFrame) -> DataFrame:
    """Dates that occur on both sides; empty unless there is a leak."""
    return a.select(S.TS).intersect(b.select(S.TS))


def rows_on_dates(df: DataFrame, dates: DataFrame, bounded: bool = True) -> DataFrame:
    """Rows whose date is in ``dates``."""
    return join_per_date(df, dates.select(S.TS).distinct(), "left_semi", bounded)


def tuning_split(folds: Sequence[Fold]) -> tuple[list[Fold], Fold]:
    """(folds for tuning, the last fold kept for the final check)."""
    folds = check_fold_list(folds)
    if len(folds) < 2:
        raise ValueError("a tuning split needs at least two folds")
    return folds[:-1], folds[-1]


def tuning_rows(df: DataFrame, folds: Sequence[Fold]) -> DataFrame:
    """Rows up to the end of the last tuning fold."""
    tuning, _ = tuning_split(folds)
    return df.where(F.col(S.TS) <= tuning[-1].valid_end)


def date_kfold(axis: DataFrame, n_splits: int = 8, seed: int | None = 0) -> DataFrame:
    """(TS, fold 0..n_splits-1): whole dates in one fold, shuffled by a seeded hash.

    Not chronological: a fold is tested by models that saw later dates.  With
    ``seed=None`` dates are dealt out in order instead.
    """
    if n_splits < 2:
        raise ValueError("n_splits must be at least 2")
    if seed is None:
        position = F.col("date_idx") - 1
    else:
        # seeded shuffle of the (bounded) dates, then equal-sized deal as a K-fold has
        shuffled = Window.orderBy(F.md5(F.concat(F.col(S.TS), F.lit(f":{seed}"))), S.TS)
        position = F.row_number().over(shuffled) - 1
    return axis.select(S.TS, (position % n_splits).cast("int").alias("fold"))
