"""Data-understanding reports: missing values, keys, counts and categories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel import schema as S
from tidepanel.operators.quality import key_report


def null_counts(df: DataFrame, columns: Sequence[str] | None = None, by: str | None = None) -> DataFrame:
    """(column, nb_missing, pct_missing[, by]): one aggregation over all columns.

    With ``by`` the overall figures come along as the group NULL, from the same pass.
    """
    columns = list(columns or df.columns)
    S.require_columns(df, columns + ([by] if by else []), "null audit")
    counts = [F.count_if(F.col(c).isNull()).alias(f"n_{i}") for i, c in enumerate(columns)]
    grouped = df.cube(by).agg(F.count("*").alias("n"), *counts) if by else df.agg(F.count("*").alias("n"), *counts)
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n_{i}").alias("nb_missing")) for i, c in enumerate(columns)])
    return grouped.select(*([by] if by else []), "n", F.explode(entries).alias("e")).select(
        *([by] if by else []),
        F.col("e.column").alias("column"),
        F.col("e.nb_missing").alias("nb_missing"),
        F.try_divide(F.col("e.nb_missing") * F.lit(100.0), F.col("n")).alias("pct_missing"),
    )


def columns_with_nulls(df: DataFrame) -> DataFrame:
    """Only the columns that miss a value, most incomplete first."""
    found = null_counts(df).where(F.col("nb_missing") >= 1)
    return found.select("column", "nb_missing").orderBy(F.desc("nb_missing"), "column")


def null_total(df: DataFrame) -> DataFrame:
    """Number of missing cells of a table."""
    return null_counts(df).agg(F.sum("nb_missing").alias("nb_missing"))


def duplicate_keys(df: DataFrame, key: str = S.ROW_ID) -> DataFrame:
    """Rows beyond the first of each key; NULL counts as one key."""
    per_key = df.groupBy(key).agg(F.count("*").alias("n"))
    return per_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_keys")).withColumn(
        "n_duplicates", F.col("n_rows") - F.col("n_keys")
    )


def key_alignment(a: DataFrame, b: DataFrame, key: str = S.ROW_ID) -> DataFrame:
    """Do two tables have the same rows, by key?"""
    report = key_report(a, b, key)
    aligned = (F.col("n_found") == F.col("n_expected")) & (F.col("n_missing") == 0) & (F.col("n_surplus") == 0)
    return report.withColumn("aligned", aligned)


def same_columns(a: DataFrame, b: DataFrame) -> bool:
    """Equal column sets; schema only."""
    return set(a.columns) == set(b.columns)


def distinct_counts(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """(column, n_distinct), NULL not counted."""
    S.require_columns(df, columns, "distinct counts")
    if approximate:
        wide = df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns])
        return wide.unpivot([], list(columns), "column", "n_distinct")
    # one row per (column, value) before anything is counted: partial aggregation
    # keeps the shuffle at the number of distinct values per task
    typed = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    pairs = typed.unpivot([], list(columns), "column", "value").where(F.col("value").isNotNull()).distinct()
    return pairs.groupBy("column").agg(F.count("*").alias("n_distinct"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """(value, n); NULL left out; ``top`` keeps the most frequent, ties by value."""
    counted = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), column).limit(top) if top else counted


def class_shares(df: DataFrame, label: str = S.LABEL) -> DataFrame:
    """(class, n, pct): the total is a sum over the (at most two) classes."""
    from pyspark.sql import Window

    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return counts.withColumn("pct", F.col("n") * F.lit(100.0) / total)


def category_difference(a: DataFrame, b: DataFrame, columns: Sequence[str], names: tuple[str, str] = ("train", "test")) -> DataFrame:
    """(column, n_<a>, n_<b>, only_<a>, only_<b>) of the distinct values."""
    seen = None
    for df, side in ((a, 0), (b, 1)):
        typed = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
        values = typed.unpivot([], list(columns), "column", "value").where(F.col("value").isNotNull())
        values = values.groupBy("column", "value").agg(F.lit(side).alias("side"))
        seen = values if seen is None else seen.unionByName(values)
    where = seen.groupBy("column", "value").agg(
        F.max((F.col("side") == 0).cast("int")).alias("in_a"), F.max((F.col("side") == 1).cast("int")).alias("in_b")
    )
    return where.groupBy("column").agg(
        F.sum("in_a").alias(f"n_{names[0]}"),
        F.sum("in_b").alias(f"n_{names[1]}"),
        F.count_if((F.col("in_a") == 1) & (F.col("in_b") == 0)).alias(f"only_{names[0]}"),
        F.count_if((F.col("in_a") == 0) & (F.col("in_b") == 1)).alias(f"only_{names[1]}"),
    )


def positive_rate_by_date(df: DataFrame, label: str = S.LABEL) -> DataFrame:
    return df.groupBy(S.TS).agg(F.avg(label).alias("positive_rate"))


def rows_per_date(df: DataFrame) -> DataFrame:
    return df.groupBy(S.TS).agg(F.count("*").alias("n_rows"))


def mean_returns_by_class(df: DataFrame) -> DataFrame:
    """(ret, mean_0, mean_1, diff_mean) for RET_1..RET_20: one conditional aggregation."""
    S.require_columns(df, [*S.RETURNS, S.LABEL], "mean returns")
    sums = [
        F.avg(F.when(F.col(S.LABEL) == k, F.col(c))).alias(f"{c}_{k}") for c in S.RETURNS for k in (0, 1)
    ]
    entries = F.array(
        *[
            F.struct(F.lit(c).alias("ret"), F.col(f"{c}_0").alias("mean_0"), F.col(f"{c}_1").alias("mean_1"))
            for c in S.RETURNS
        ]
    )
    return (
        df.agg(*sums)
        .select(F.inline(entries))
        .withColumn("diff_mean", F.col("mean_1") - F.col("mean_0"))
    )


def class_counts_by_allocation(df: DataFrame, top: int | None = None) -> DataFrame:
    """Counts of both classes and percent of class 1 per entity; ``top`` by positives, ties by name."""
    counted = df.groupBy(S.ALLOCATION).agg(
        F.sum(S.LABEL).alias("class_1"), F.sum(1 - F.col(S.LABEL)).alias("class_0")
    )
    counted = counted.withColumn(
        "pct_of_class_1", F.col("class_1") * F.lit(100.0) / (F.col("class_1") + F.col("class_0"))
    )
    return counted.orderBy(F.desc("class_1"), S.ALLOCATION).limit(top) if top else counted


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    """First n rows by key."""
    return df.orderBy(S.ROW_ID).limit(n)
