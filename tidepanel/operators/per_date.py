"""Joining rows with tables that hold one (short) row per date.

The data contract fixes TS to ``DATE_nnnn``, so such a table has at most 10,000
rows.  The bound is enforced in the query itself: a value of another form fails
the job before anything is broadcast.  Callers with free-form dates pass
``bounded=False`` and get an ordinary join (AQE decides, and splits hot dates).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel import schema as S


def checked_ts() -> Column:
    bad = F.concat(F.lit("TS must look like DATE_nnnn: "), F.coalesce(F.col(S.TS), F.lit("NULL")))
    return F.when(F.col(S.TS).rlike(S.TS_FORMAT), F.col(S.TS)).otherwise(F.raise_error(bad).cast("string"))


def join_per_date(rows: DataFrame, per_date: DataFrame, how: str = "inner", bounded: bool = True) -> DataFrame:
    """Equi-join on TS; ``rows`` are not shuffled when the date table is bounded."""
    side = F.broadcast(per_date.withColumn(S.TS, checked_ts())) if bounded else per_date
    return rows.join(side, S.TS, how)
