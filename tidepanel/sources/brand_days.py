"""A panel derived from order lines: one row per (brand, ship date).

All inputs are integers (cents, units), so any engine gives the same numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepanel import schema as S
from tidepanel.functions.rules import class_of
from tidepanel.functions.sizing import kept

# Size of the test period and shape of the volume gaps.
TEST_DATES = 120
MAX_DATE_NUMBER = 9999


def _lines(spark: SparkSession, root: str) -> DataFrame:
    line = spark.read.parquet(f"{root}/lineitem.parquet").select(
        "l_partkey",
        F.col("l_shipdate").cast("date").alias("day"),
        F.rint(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"),
        (F.col("l_quantity").cast("bigint") * F.when(F.col("l_returnflag") == "R", -1).otherwise(1)).alias("units"),
    )
    part = spark.read.parquet(f"{root}/part.parquet").select("p_partkey", F.col("p_brand").alias(S.ALLOCATION))
    # No hint: Catalyst broadcasts `part` only below its size threshold, and beyond
    # it AQE splits the skewed partitions of a hot part key.
    return line.join(part, F.col("l_partkey") == F.col("p_partkey"), "inner")


def _brand_days(lines: DataFrame, turnover: bool) -> DataFrame:
    key = [S.ALLOCATION, "day"]
    if not turnover:
        return lines.groupBy(*key).agg(F.sum("cents").alias("rev"), F.sum("units").alias("sv"))
    # Exact median without gathering a brand-day in memory: equal prices collapse
    # before the shuffle, a running count over the distinct prices finds the middle.
    prices = lines.groupBy(*key, "cents").agg(F.count("*").alias("n"), F.sum("units").alias("units"))
    group = Window.partitionBy(*key)
    ranked = prices.withColumn("upto", F.sum("n").over(group.orderBy("cents"))).withColumn(
        "total", F.sum("n").over(group)
    )
    middle = F.min(F.when(F.col("upto") * 2 >= F.col("total"), F.col("cents")))
    next_up = F.min(F.when(F.col("upto") * 2 > F.col("total"), F.col("cents")))
    return ranked.groupBy(*key).agg(
        F.sum(F.col("n") * F.col("cents")).alias("rev"),
        F.sum("units").alias("sv"),
        ((middle + next_up) / F.lit(200.0)).alias(S.TURNOVER),
    )


def _numbered_days(rows: DataFrame) -> DataFrame:
    """Distinct days with their number; bounded by the four digits of TS, enforced."""
    order = Window.orderBy("day")
    days = rows.select("day").distinct().withColumn("date_idx", F.row_number().over(order))
    days = days.withColumn("n_dates", F.count("*").over(Window.partitionBy()))
    guarded = F.when(F.col("date_idx") <= MAX_DATE_NUMBER, F.col("date_idx")).otherwise(
        F.raise_error(F.lit("more dates than DATE_nnnn can number")).cast("int")
    )
    return days.withColumn("date_idx", guarded)


def brand_day_panel(spark: SparkSession, root: str, turnover: bool = True) -> DataFrame:
    """The whole panel with ``target``, ``date_idx`` and ``n_dates``.

    Windows run per entity over its dates, at most 9,999 rows each.
    ``turnover=False`` leaves the median out for callers that do not read it.
    """
    lines = _lines(spark, root)
    # The lines are read once: the short table of brand-days is kept, and the days come from it.
    days = kept(_brand_days(lines, turnover))
    base = days.join(F.broadcast(_numbered_days(days)), "day")
    over = f"over (partition by {S.ALLOCATION} order by day)"
    before, after = f"lag(rev) {over}", f"lead(rev) {over}"
    base = base.selectExpr(
        "*",
        f"cast(substring_index({S.ALLOCATION}, '#', -1) as int) as brand_no",
        f"try_divide(rev - {before}, rev + {before}) as ret",
        f"try_divide({after} - rev, {after} + rev) as {S.TARGET}",
    )
    # Four digits of the row id are the brand's number; a longer one must not pass as another brand's day.
    base = base.withColumn("brand_no", F.expr("if(brand_no < 10000, brand_no, raise_error('brand number over 9999'))").cast("int"))
    shown = "(date_idx * 31 + brand_no * 17) % 4 = 0"
    volumes = [f"cast(case when {shown} then sv end as double) as {S.VOLUMES[0]}"]
    volumes += [f"cast(lag(sv, {i}) {over} as double) as {c}" for i, c in enumerate(S.VOLUMES) if i]
    return base.selectExpr(
        f"cast(date_idx as bigint) * 10000 + brand_no as {S.ROW_ID}",
        f"concat('DATE_', lpad(cast(date_idx as string), 4, '0')) as {S.TS}",
        S.ALLOCATION,
        f"brand_no % 4 + 1 as `{S.GROUP}`",
        *([S.TURNOVER] if turnover else []),
        *[f"lag(ret, {i}) {over} as {c}" for i, c in enumerate(S.RETURNS)],
        *volumes,
        S.TARGET,
        "date_idx",
        "n_dates",
    )


def train_panel(panel: DataFrame) -> DataFrame:
    """Labelled rows before the last 120 dates."""
    rows = panel.where(F.col("date_idx") <= F.col("n_dates") - TEST_DATES)
    return rows.withColumn(S.LABEL, class_of(S.TARGET)).drop("date_idx", "n_dates")


def test_panel(panel: DataFrame) -> DataFrame:
    """Feature rows of the last 120 dates, without the target."""
    return panel.where(F.col("date_idx") > F.col("n_dates") - TEST_DATES).drop("date_idx", "n_dates", S.TARGET)
