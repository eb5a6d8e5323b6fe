"""Prediction rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidepanel import schema as S
from tidepanel.functions.rowstats import row_mean

# Strategy names and the lags they read.
MAJORITY = "majority"
AGGREGATED_LAGS = ["RET_1", "RET_2", "RET_3"]


def binary(condition: Column) -> Column:
    """1 where the condition holds, else 0; NULL conditions give 0."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def class_of(value: str | Column) -> Column:
    """Label of a continuous value: 1 iff it is positive (0 and NULL give 0)."""
    return binary((F.col(value) if isinstance(value, str) else value) > 0)


# every rule that needs no training; the majority class is handled per fold
RULES = {
    "always_0": lambda: F.lit(0),
    "always_1": lambda: F.lit(1),
    "momentum": lambda: binary(F.col("RET_1") > 0),
    "reversal": lambda: binary(F.col("RET_1") < 0),
    "agr_momentum": lambda: binary(row_mean(AGGREGATED_LAGS) > 0),
    "agr_reversal": lambda: binary(row_mean(AGGREGATED_LAGS) < 0),
}


def rule_columns() -> dict[str, Column]:
    """Predictions of all untrained rules."""
    return {name: make() for name, make in RULES.items()}


def rule_inputs(name: str) -> list[str]:
    """Columns that a rule reads, for plan-time checks."""
    if name in ("momentum", "reversal"):
        return ["RET_1"]
    return list(AGGREGATED_LAGS) if name.startswith("agr_") else []


def rule_score(slope: float = 1.0) -> Column:
    """Probability-like score of the reversal rule: 0.5 - slope/2 * RET_1, clipped to [0, 1]."""
    raw = F.lit(0.5) - F.lit(slope / 2) * F.coalesce(F.col("RET_1"), F.lit(0.0))
    return F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0))


def with_rule(df, name: str):
    """Add ``prediction`` of one untrained rule."""
    S.require_columns(df, rule_inputs(name), f"rule {name}")
    return df.withColumn(S.PREDICTION, rule_columns()[name])
