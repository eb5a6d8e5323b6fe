"""Checks of predictions, feature tables and submissions.

Row order has no meaning in a distributed table: "same rows" is tested as key
uniqueness plus equality of the key sets.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel import schema as S


def build_submission(scored: DataFrame) -> DataFrame:
    """(ROW_ID, prediction int); ids travel with their rows, never by position."""
    S.require_columns(scored, [S.ROW_ID, S.PREDICTION], "scored rows")
    return scored.select(S.ROW_ID, F.col(S.PREDICTION).cast("int").alias(S.PREDICTION))


def key_report(
    found: DataFrame, expected: DataFrame, key: str = S.ROW_ID, counts: Mapping[str, Column] | None = None
) -> DataFrame:
    """Counts of the keys of two tables: rows, NULLs, repeats, missing and surplus keys.

    Both sides are counted per key before they meet, so a repeated key is one row.
    ``counts`` names conditions on the found rows to be counted in the same pass.
    """
    counts = dict(counts or {})
    extra = [c.cast("int").alias(name) for name, c in counts.items()]
    tagged = (
        found.select(key, F.lit(1).alias("f"), F.lit(0).alias("e"), *extra)
        .unionByName(expected.select(key, F.lit(0).alias("f"), F.lit(1).alias("e"), *[F.lit(0).alias(n) for n in counts]))
        .groupBy(key)
        .agg(F.sum("f").alias("f"), F.sum("e").alias("e"), *[F.sum(n).alias(n) for n in counts])
    )
    known = F.col(key).isNotNull()
    return tagged.agg(
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in counts],
        F.coalesce(F.sum("f"), F.lit(0)).alias("n_found"),
        F.coalesce(F.sum("e"), F.lit(0)).alias("n_expected"),
        F.coalesce(F.sum(F.when(~known, F.col("f"))), F.lit(0)).alias("n_null_keys"),
        F.coalesce(F.sum(F.when(F.col("f") > 1, F.col("f") - 1)), F.lit(0)).alias("n_repeated"),
        F.count_if(known & (F.col("f") == 0)).alias("n_missing"),
        F.count_if(known & (F.col("e") == 0)).alias("n_surplus"),
    )


def prediction_report(df: DataFrame) -> DataFrame:
    """Rows, NULL predictions, values outside {0, 1}, positives and their rate."""
    p = F.col(S.PREDICTION)
    return df.agg(
        F.count("*").alias("n_rows"),
        F.count_if(p.isNull()).alias("n_null"),
        F.count_if(p.isNotNull() & ~p.isin(0, 1)).alias("n_not_binary"),
        F.count_if(p == 1).alias("n_positive"),
        F.avg((p == 1).cast("int")).alias("positive_rate"),
    )


def submission_report(submission: DataFrame, expected: DataFrame) -> DataFrame:
    """One row with all counts of both reports and ``ok``."""
    p = F.col(S.PREDICTION)
    both = key_report(
        submission,
        expected,
        counts={
            "n_null": p.isNull(),
            "n_not_binary": p.isNotNull() & ~p.isin(0, 1),
            "n_positive": F.coalesce(p == 1, F.lit(False)),
        },
    )
    both = both.withColumns(
        {
            "n_rows": F.col("n_found"),
            "positive_rate": F.try_divide(F.col("n_positive"), F.col("n_found") - F.col("n_null")),
        }
    )
    faults = ["n_null_keys", "n_repeated", "n_missing", "n_surplus", "n_null", "n_not_binary"]
    ok = F.col("n_found") == F.col("n_expected")
    for name in faults:
        ok = ok & (F.col(name) == 0)
    return both.withColumn("ok", ok)


def order_report(found: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: n_found, n_expected, n_out_of_place, same_order, from two tables (position, ROW_ID); rows meet by position."""
    a = found.select("position", F.col(S.ROW_ID).alias("found_id"), F.lit(True).alias("is_found"))
    b = expected.select("position", F.col(S.ROW_ID).alias("expected_id"), F.lit(True).alias("is_expected"))
    both = a.join(b, "position", "full")
    same = F.col("is_found") & F.col("is_expected") & F.col("found_id").eqNullSafe(F.col("expected_id"))
    counts = both.agg(
        F.count("is_found").alias("n_found"), F.count("is_expected").alias("n_expected"), F.count_if(~F.coalesce(same, F.lit(False))).alias("n_out_of_place")
    )
    return counts.withColumn("same_order", F.col("n_out_of_place") == 0)


def check_order(found: DataFrame, expected: DataFrame) -> None:
    """Both files list the same ids in the same order; else ValueError."""
    _refuse(order_report(found, expected).first(), {"n_out_of_place": "ids are not in the expected order"})


def _refuse(row, messages: dict[str, str]) -> None:
    for name, message in messages.items():
        if row[name]:
            raise ValueError(f"{message} ({row[name]} rows)")


def check_predictions(predicted: DataFrame, expected: DataFrame) -> None:
    """Same keys as the validation rows, no NULL, only 0 and 1; else ValueError."""
    S.require_columns(predicted, [S.ROW_ID, S.PREDICTION], "predictions")
    _refuse(
        submission_report(predicted, expected).first(),
        {
            "n_missing": "predictions lost rows",
            "n_surplus": "predictions have unknown rows",
            "n_repeated": "predictions repeat rows",
            "n_null": "predictions contain NULL",
            "n_not_binary": "predictions must be 0 or 1",
        },
    )


def check_submission(submission: DataFrame, expected: DataFrame) -> None:
    """Exact columns, complete unique keys, binary predictions; else ValueError."""
    if submission.columns != [S.ROW_ID, S.PREDICTION]:
        raise ValueError(f"submission columns must be ROW_ID, prediction, not {submission.columns}")
    row = submission_report(submission, expected).first()
    _refuse(
        row,
        {
            "n_null_keys": "submission has NULL ids",
            "n_repeated": "submission repeats ids",
            "n_missing": "submission lacks ids",
            "n_surplus": "submission has unknown ids",
            "n_null": "submission has NULL predictions",
            "n_not_binary": "submission predictions must be 0 or 1",
        },
    )
    if row["n_found"] != row["n_expected"]:
        raise ValueError("submission and test set differ in their number of rows")


def check_features(
    train: DataFrame, test: DataFrame, features: Sequence[str], infinities: bool = True
) -> None:
    """Features present on both sides, named once and (one job per side) finite."""
    S.require_columns(train, features, "train features")
    S.require_columns(test, features, "test features")
    repeated = sorted({f for f in features if list(features).count(f) > 1})
    if repeated:
        raise ValueError(f"features named twice: {repeated}")
    if infinities:
        for df, side in ((train, "train"), (test, "test")):
            found = infinity_counts(df, features).first().asDict()
            bad = sorted(name for name, n in found.items() if n)
            if bad:
                raise ValueError(f"infinite values in {side} features {bad}")


def infinity_counts(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Number of infinite values per feature, one pass."""
    return df.agg(
        *[F.count_if(F.abs(F.col(c).cast("double")) == F.lit(float("inf"))).alias(c) for c in features]
    )
