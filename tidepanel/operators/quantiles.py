"""Exact quantiles of any number of rows and groups, without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel import schema as S
from tidepanel.functions.sizing import kept

SKETCH_ACCURACY = 10_000
# Intervals of a bracket whose values are sorted apart.
SLOTS = 256


def long_values(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, column, value) without NULLs: one output row per value."""
    S.require_columns(df, [*columns, *by], "values")
    typed = df.select(*by, *[F.col(c).cast("double").alias(c) for c in columns])
    return typed.unpivot([F.col(b) for b in by], list(columns), "column", "value").where(F.col("value").isNotNull())


def interpolated(low: Column, high: Column, share: Column) -> Column:
    """``low * (1 - share) + high * share``, the first product not rounded before the sum: a fused multiply-add, as DuckDB's
    ``quantile_cont`` computes it.  Fences that follow from quartiles meet values exactly, so the last bit counts.
    """
    def halves(x: Column) -> tuple[Column, Column]:
        scaled = x * F.lit(134217729.0)
        top = scaled - (scaled - x)
        return top, x - top

    rest, other = F.lit(1.0) - share, high * share
    product = low * rest
    (a, b), (c, d) = halves(low), halves(rest)
    total = product + other
    back = total - product
    lost = (product - (total - back)) + (other - back) + ((((a * c - product) + a * d) + b * c) + b * d)
    small = F.greatest(F.abs(low), F.abs(high)) < 1e290  # beyond that the halves overflow
    return F.when(share == 0, low).when(small, total + lost).otherwise(total)


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float] = (0.25, 0.5, 0.75),
    by: Sequence[str] = (),
    accuracy: int = SKETCH_ACCURACY,
    moments: bool = False,
) -> DataFrame:
    """(by, column, n, q_0, q_1, ...) with linear interpolation between order statistics.

    ``moments`` adds mean, std (n-1), least and most from the pass of the sketch.

    Two passes.  A mergeable sketch brackets every quantile between two values
    whose ranks differ by at most a few ``1/accuracy`` of the rows.  Then rows
    are counted: one count for everything between two brackets, and one per
    distinct value inside a bracket.  Only that list is sorted, by intervals of
    its values, so a task holds a part of a bracket.  The result is exact; if
    a sketch broke its error bound the job would fail instead of guessing.

    The table of brackets has one row per column and group.  Without ``by`` that
    bounds it and it is broadcast; with ``by`` the join is left to Catalyst.
    """
    probabilities = list(probabilities)
    if sorted(probabilities) != probabilities or not all(0 <= p <= 1 for p in probabilities):
        raise ValueError("probabilities must ascend within [0, 1]")
    key = [*by, "column"]
    values = long_values(df, columns, by)
    margin = 3.0 / accuracy
    marks = [m for p in probabilities for m in (max(p - margin, 0.0), min(p + margin, 1.0))]
    sketch = values.groupBy(*key).agg(
        F.percentile_approx("value", marks, accuracy).alias("marks"),
        F.min("value").alias("least"),
        F.max("value").alias("most"),
        (F.count("*") <= 2 * accuracy).alias("short"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
    )

    # Cells in ascending order: below a bracket (coarse), inside it (one per value).
    # A short group (at most 2 * accuracy rows) is one bracket: there the margin
    # would be less than the ranks between which a quantile is interpolated.
    def bound(j: int):
        p = marks[j]
        if p in (0.0, 1.0):
            return F.col("least") if p == 0.0 else F.col("most")
        return F.when(F.col("short"), F.col("most") if j % 2 else F.col("least")).otherwise(F.col("marks")[j])

    cell = inside = None
    for i in range(len(probabilities)):
        low, high = bound(2 * i), bound(2 * i + 1)
        v = F.col("value")
        if cell is None:
            cell, inside = F.when(v < low, 2 * i), F.when(v < low, F.lit(False))
        else:
            cell, inside = cell.when(v < low, 2 * i), inside.when(v < low, F.lit(False))
        cell, inside = cell.when(v <= high, 2 * i + 1), inside.when(v <= high, F.lit(True))
    cell, inside = cell.otherwise(2 * len(probabilities)), inside.otherwise(F.lit(False))

    if not by:  # one row per column; with groups Catalyst chooses, and AQE splits a skewed one
        sketch = F.broadcast(kept(sketch) if moments else sketch)
    placed = values.join(sketch, key).withColumn("cell", cell).withColumn("inside", inside)
    # A bracket is parted into equal intervals of its values: each is sorted by itself.
    which = (F.floor(F.col("cell") / 2) + 1).cast("int")
    lows, highs = (F.array(*[bound(2 * i + side) for i in range(len(probabilities))]) for side in (0, 1))
    low, high = F.get(lows, which - 1), F.get(highs, which - 1)
    part = F.least(F.floor((F.col("value") - low) / (high - low) * SLOTS), F.lit(SLOTS - 1)).cast("int")
    placed = placed.withColumn("slot", F.when(F.col("inside") & (high > low), part).otherwise(0))
    counts = placed.groupBy(*key, "cell", "slot", F.when(F.col("inside"), F.col("value")).alias("value")).agg(
        F.count("*").alias("rows")
    )
    # Rows before each interval: a running sum over SLOTS intervals per bracket at most.
    slots = counts.groupBy(*key, "cell", "slot").agg(F.sum("rows").alias("slot_rows"))
    everything = Window.partitionBy(*key)
    ahead = everything.orderBy("cell", "slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.withColumn("before", F.coalesce(F.sum("slot_rows").over(ahead), F.lit(0))).withColumn("n", F.sum("slot_rows").over(everything))
    running = Window.partitionBy(*key, "cell", "slot").orderBy("value")
    ranked = counts.join(slots.drop("slot_rows"), [*key, "cell", "slot"]).withColumn("upto", F.col("before") + F.sum("rows").over(running))
    picks = {}
    for i, p in enumerate(probabilities):
        position = F.lit(p) * (F.col("n") - 1)
        for side, rank in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            here = (F.col("upto") > rank) & (F.col("upto") - F.col("rows") <= rank)
            found = F.when(
                here,
                F.coalesce(F.col("value"), F.raise_error(F.lit("quantile sketch out of bounds")).cast("double")),
            )
            picks[f"{side}_{i}"] = F.max(found)
    picked = ranked.groupBy(*key).agg(F.max("n").alias("n"), *[c.alias(n) for n, c in picks.items()])
    share = {i: F.lit(p) * (F.col("n") - 1) - F.floor(F.lit(p) * (F.col("n") - 1)) for i, p in enumerate(probabilities)}
    found = picked.select(
        *key,
        "n",
        *[
            interpolated(F.col(f"lo_{i}"), F.col(f"hi_{i}"), share[i]).alias(f"q_{i}")
            for i in range(len(probabilities))
        ],
    )
    return found.join(sketch.select(*key, "mean", "std", "least", "most"), key) if moments else found
