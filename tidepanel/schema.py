"""Column names, table schemas and limits of the panel data model.

A panel holds one row per (date ``TS``, entity ``ALLOCATION``) with twenty
lagged returns and twenty lagged signed volumes.  The lags are wide columns, not
arrays: Parquet prunes them one by one and expressions stay in generated code.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Names and limits of the data contract.
ROW_ID = "ROW_ID"
TS = "TS"
ALLOCATION = "ALLOCATION"
GROUP = "GROUP"
TURNOVER = "MEDIAN_DAILY_TURNOVER"
TARGET = "target"
LABEL = "class"
PREDICTION = "prediction"
PROBABILITY = "p1"
N_LAGS = 20
TS_FORMAT = "^DATE_[0-9]{4}$"
MAX_DATES = 10_000  # number of values that TS_FORMAT admits
FOLD_SIZE = 120
FOLD_COUNT = 4
NON_FEATURES = ("ROW_ID", "TS", "ALLOCATION", "target", "class")

RETURNS = [f"RET_{i}" for i in range(1, N_LAGS + 1)]
VOLUMES = [f"SIGNED_VOLUME_{i}" for i in range(1, N_LAGS + 1)]

PANEL_SCHEMA = T.StructType(
    [
        T.StructField(ROW_ID, T.LongType()),
        T.StructField(TS, T.StringType()),
        T.StructField(ALLOCATION, T.StringType()),
        T.StructField(GROUP, T.IntegerType()),
        T.StructField(TURNOVER, T.DoubleType()),
        *[T.StructField(c, T.DoubleType()) for c in RETURNS],
        *[T.StructField(c, T.DoubleType()) for c in VOLUMES],
    ]
)
LABEL_SCHEMA = T.StructType(
    [T.StructField(ROW_ID, T.LongType()), T.StructField(TARGET, T.DoubleType())]
)
KEY_SCHEMA = T.StructType([T.StructField(ROW_ID, T.LongType())])
SUBMISSION_SCHEMA = T.StructType([T.StructField(ROW_ID, T.LongType()), T.StructField(PREDICTION, T.IntegerType())])


def require_columns(df, columns, context: str = "input") -> None:
    """Plan-time check that ``columns`` exist; runs no job."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{context}: missing columns {missing}")
