"""Feature families: narrow projections, no shuffle and no Python in the data path.

Averages are made in one ``select`` and used by the next ones; Spark keeps such
projections apart when a column is used several times, so nothing is recomputed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel import schema as S
from tidepanel.functions.rowstats import row_mean, row_std

# Windows, names and constants of the feature definitions.
MOMENTUM_WINDOWS = (3, 5, 10, 20)
VOLATILITY_WINDOWS = (3, 20)
VOLUME_WINDOWS = (3, 20)
PERFORMANCE_WINDOWS = (3, 5, 10, 15, 20)
RATIO_EPSILON = 1e-4

MOMENTUM = ["momentum_3", "momentum_5", "momentum_10", "momentum_20", "delta_momentum_3_20"]
VOLATILITY = ["volatility_3", "volatility_20", "delta_volatility_3_20"]
RATIO = ["momentum_volatility_ratio_20"]
VOLUME = ["volume_3", "volume_20", "delta_volume_3_20"]
AVERAGE_PERF = [f"AVERAGE_PERF_{w}" for w in PERFORMANCE_WINDOWS]
STD_PERF = ["STD_PERF_20"]


def with_momentum(df: DataFrame) -> DataFrame:
    """Mean return over several horizons, and short minus long."""
    S.require_columns(df, S.RETURNS, "momentum")
    df = df.withColumns({f"momentum_{w}": row_mean(S.RETURNS[:w]) for w in MOMENTUM_WINDOWS})
    return df.withColumn("delta_momentum_3_20", F.col("momentum_3") - F.col("momentum_20"))


def with_volatility(df: DataFrame) -> DataFrame:
    """Sample deviation of the returns over two horizons, and short minus long."""
    S.require_columns(df, S.RETURNS, "volatility")
    helpers = {f"__mean_{w}": row_mean(S.RETURNS[:w]) for w in VOLATILITY_WINDOWS}
    df = df.withColumns(helpers)
    df = df.withColumns({f"volatility_{w}": row_std(S.RETURNS[:w], f"__mean_{w}") for w in VOLATILITY_WINDOWS})
    return df.drop(*helpers).withColumn("delta_volatility_3_20", F.col("volatility_3") - F.col("volatility_20"))


def with_momentum_volatility_ratio(df: DataFrame, epsilon: float = RATIO_EPSILON) -> DataFrame:
    """Long momentum per unit of long volatility; needs both families."""
    S.require_columns(df, MOMENTUM[:4] + VOLATILITY[:2], "ratio")
    return df.withColumn(RATIO[0], F.try_divide(F.col("momentum_20"), F.col("volatility_20") + F.lit(epsilon)))


def with_volume(df: DataFrame) -> DataFrame:
    """Mean signed volume over two horizons, and short minus long."""
    S.require_columns(df, S.VOLUMES, "volume")
    df = df.withColumns({f"volume_{w}": row_mean(S.VOLUMES[:w]) for w in VOLUME_WINDOWS})
    return df.withColumn("delta_volume_3_20", F.col("volume_3") - F.col("volume_20"))


def with_engineered(df: DataFrame) -> DataFrame:
    """All twelve engineered columns, the same for train and test."""
    return with_volume(with_momentum_volatility_ratio(with_volatility(with_momentum(df))))


def with_performance(df: DataFrame) -> DataFrame:
    """Row means AVERAGE_PERF_w and the row deviation STD_PERF_20."""
    S.require_columns(df, S.RETURNS, "performance")
    df = df.withColumns({f"AVERAGE_PERF_{w}": row_mean(S.RETURNS[:w]) for w in PERFORMANCE_WINDOWS})
    return df.withColumn("STD_PERF_20", row_std(S.RETURNS[:20], "AVERAGE_PERF_20"))


def fill_zero(df: DataFrame, columns: list[str]) -> DataFrame:
    """Constant imputation with 0."""
    return df.fillna(0.0, subset=columns)


def numeric_features(df: DataFrame) -> list[str]:
    """Numeric columns except keys and labels, in table order."""
    found = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in S.NON_FEATURES]
    if not found:
        raise ValueError("no numeric feature column found")
    return found


def return_features(df: DataFrame) -> list[str]:
    """RET_1..RET_20 after a presence check."""
    S.require_columns(df, S.RETURNS, "returns")
    return list(S.RETURNS)


def feature_sets() -> dict[str, list[str]]:
    """Named column lists used by the studies."""
    return {
        "raw": list(S.RETURNS),
        "momentum": list(MOMENTUM),
        "momentum_compact": ["momentum_3", "momentum_20", "delta_momentum_3_20"],
        "volatility": list(VOLATILITY),
        "momentum_volatility": ["volatility_3", "volatility_20", "momentum_3", "momentum_20", RATIO[0]],
        "ratio": list(RATIO),
        "volume": list(VOLUME),
        "performance": S.RETURNS
        + S.VOLUMES
        + [S.TURNOVER]
        + AVERAGE_PERF
        + [f"ALLOCATIONS_{c}" for c in AVERAGE_PERF]
        + STD_PERF
        + [f"ALLOCATIONS_{c}" for c in STD_PERF],
        "engineered": S.RETURNS + S.VOLUMES + [S.GROUP, S.TURNOVER] + MOMENTUM + VOLATILITY + RATIO + VOLUME,
    }
