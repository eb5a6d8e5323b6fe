"""Distribution profiles: the numbers behind density, histogram and box plots."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel import schema as S
from tidepanel.operators.quantiles import exact_quantiles, long_values

# Plot defaults.
HISTOGRAM_BINS = 100
DENSITY_BINS = 1000
DENSITY_GRID = 200
DENSITY_CUT = 3.0
WHISKER = 1.5


def describe(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, column, count, mean, std, min, q25, median, q75, max), exact quartiles."""
    found = exact_quantiles(df, columns, (0.25, 0.5, 0.75), by, moments=True)
    return found.select(
        *by, "column", F.col("n").alias("count"), "mean", "std", F.col("least").alias("min"),
        F.col("q_0").alias("q25"), F.col("q_1").alias("median"), F.col("q_2").alias("q75"), F.col("most").alias("max"),
    )


def describe_rows_per_date(df: DataFrame) -> DataFrame:
    """Describe the number of rows per date."""
    return describe(df.groupBy(S.TS).agg(F.count("*").alias("n_rows")), ["n_rows"])


def describe_positive_rate(df: DataFrame) -> DataFrame:
    """Describe the share of class 1 per date."""
    return describe(df.groupBy(S.TS).agg(F.avg(S.LABEL).alias("positive_rate")), ["positive_rate"])


def centre_lines(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, mean, median): the guide lines of the plots."""
    return exact_quantiles(df, columns, (0.5,), moments=True).select("column", "mean", F.col("q_0").alias("median"))


def box_stats(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Quartiles, whiskers (last value within 1.5 IQR) and number of outliers."""
    key = [*by, "column"]
    quartiles = exact_quantiles(df, columns, (0.25, 0.5, 0.75), by).select(
        *key, F.col("q_0").alias("q25"), F.col("q_1").alias("median"), F.col("q_2").alias("q75")
    )
    spread = F.col("q75") - F.col("q25")
    fences = quartiles.withColumns(
        {"low_fence": F.col("q25") - WHISKER * spread, "high_fence": F.col("q75") + WHISKER * spread}
    )
    inside = F.col("value").between(F.col("low_fence"), F.col("high_fence"))
    return (
        long_values(df, columns, by)
        .join(fences, key)
        .groupBy(*key, "q25", "median", "q75")
        .agg(
            F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
            F.count_if(~inside).alias("n_outliers"),
        )
    )


def _range(df: DataFrame, column: str):
    return df.agg(
        F.count(column).alias("n"),
        F.min(column).cast("double").alias("lo"),
        F.max(column).cast("double").alias("hi"),
        F.stddev_samp(column).alias("sd"),
    ).first()


def _bin_counts(df: DataFrame, column: str, lo: float, hi: float, bins: int) -> DataFrame:
    """(bin 0..bins-1, n) with equal widths; the last bin includes the maximum."""
    value = F.col(column).cast("double")
    width = (hi - lo) / bins
    place = F.least(F.floor((value - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)) if width > 0 else F.lit(0)
    inside = df.where(value.between(lo, hi))
    return inside.groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def histogram(df: DataFrame, column: str, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """(bin, bin_start, bin_end, n) over the whole range; empty bins included."""
    S.require_columns(df, [column], "histogram")
    r = _range(df, column)
    lo, hi = (r["lo"], r["hi"]) if r["n"] else (0.0, 0.0)
    width = (hi - lo) / bins
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (
        frame.join(F.broadcast(_bin_counts(df, column, lo, hi, bins)), "bin", "left")
        .select(
            "bin",
            (F.lit(lo) + F.col("bin") * F.lit(width)).alias("bin_start"),
            (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("bin_end"),
            F.coalesce("n", F.lit(0)).cast("long").alias("n"),
        )
    )


def densities(
    df: DataFrame,
    columns: Sequence[str],
    grid: int = DENSITY_GRID,
    bins: int = DENSITY_BINS,
    window: tuple[float, float] | None = None,
) -> DataFrame:
    """(column, point, x, density): Gaussian kernel estimates with Scott's bandwidth.

    Two passes for all columns.  The rows are binned (at least ``bins`` counts per
    column); the kernel runs over that table only, each bin meeting the ``grid``
    points.  ``window`` zooms the grid without changing data or bandwidth.  Bins
    are never wider than an eighth of the bandwidth; only those that hold rows exist.
    """
    S.require_columns(df, columns, "density")
    values = long_values(df, columns)
    found = values.groupBy("column").agg(
        F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.stddev_samp("value").alias("sd")
    ).collect()  # one row per column
    shapes = []
    for r in found:
        if r["n"] < 2 or not r["sd"]:
            continue
        h = r["sd"] * r["n"] ** -0.2
        cells = max(bins, math.ceil(8 * (r["hi"] - r["lo"]) / h))
        start, end = window or (r["lo"] - DENSITY_CUT * h, r["hi"] + DENSITY_CUT * h)
        scale = 1.0 / (r["n"] * h * math.sqrt(2 * math.pi))
        shapes.append(
            (r["column"], r["lo"], (r["hi"] - r["lo"]) / cells, cells, h, start, (end - start) / (grid - 1), scale)
        )
    missing = sorted(set(columns) - {s[0] for s in shapes})
    if missing:
        raise ValueError(f"density needs at least two different values: {missing}")
    shape = F.broadcast(
        df.sparkSession.createDataFrame(
            shapes,
            "column string, lo double, width double, cells bigint, h double, start double, step double, scale double",
        )
    )
    place = F.least(F.floor((F.col("value") - F.col("lo")) / F.col("width")), F.col("cells") - 1).cast("bigint")
    counts = values.join(shape, "column").groupBy("column", place.alias("bin")).agg(F.count("*").alias("n"))
    points = counts.join(shape, "column").withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
    x = F.col("start") + F.col("point") * F.col("step")
    z = (x - (F.col("lo") + (F.col("bin") + 0.5) * F.col("width"))) / F.col("h")
    return (
        points.groupBy("column", "point", "start", "step", "scale")
        .agg(F.sum(F.col("n") * F.exp(F.lit(-0.5) * z * z)).alias("mass"))
        .select("column", "point", x.alias("x"), (F.col("mass") * F.col("scale")).alias("density"))
    )


def density(
    df: DataFrame,
    column: str,
    grid: int = DENSITY_GRID,
    bins: int = DENSITY_BINS,
    window: tuple[float, float] | None = None,
) -> DataFrame:
    """(point, x, density) of one column; see :func:`densities`."""
    return densities(df, [column], grid, bins, window).drop("column")


def density_exact(df: DataFrame, column: str, grid: int = DENSITY_GRID) -> DataFrame:
    """The estimate without binning: one pass with ``grid`` partial sums per task."""
    S.require_columns(df, [column], "density")
    r = _range(df, column)
    if r["n"] < 2 or not r["sd"]:
        raise ValueError(f"density of {column} needs at least two different values")
    h = r["sd"] * r["n"] ** -0.2
    start, end = r["lo"] - DENSITY_CUT * h, r["hi"] + DENSITY_CUT * h
    step = (end - start) / (grid - 1)
    scale = 1.0 / (r["n"] * h * math.sqrt(2 * math.pi))
    rows = df.where(F.col(column).isNotNull()).select(
        F.col(column).cast("double").alias("v"), F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("point")
    )
    z = (F.lit(start) + F.col("point") * F.lit(step) - F.col("v")) / F.lit(h)
    return (
        rows.groupBy("point")
        .agg((F.sum(F.exp(F.lit(-0.5) * z * z)) * F.lit(scale)).alias("density"))
        .withColumn("x", F.lit(start) + F.col("point") * F.lit(step))
        .select("point", "x", "density")
    )
