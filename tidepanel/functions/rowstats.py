"""Row-wise statistics over wide lag columns, as plain column expressions.

Written as SQL text: sums of twenty terms are one call instead of hundreds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _total(terms: list[str]) -> str:
    """Balanced sum: keeps the expression tree shallow for code generation."""
    while len(terms) > 1:
        pairs = [f"({terms[i]} + {terms[i + 1]})" for i in range(0, len(terms) - 1, 2)]
        terms = pairs + ([terms[-1]] if len(terms) % 2 else [])
    return terms[0]


def _count(columns: Sequence[str]) -> str:
    return _total([f"cast(`{c}` is not null as int)" for c in columns])


def row_mean(columns: Sequence[str]) -> Column:
    """Mean of the non-null values of a row; NULL when there are none."""
    return F.expr(f"try_divide({_total([f'coalesce(`{c}`, 0D)' for c in columns])}, {_count(columns)})")


def row_std(columns: Sequence[str], mean: str) -> Column:
    """Sample standard deviation (n-1) of the non-null values of a row.

    ``mean`` names a column made by an earlier ``select``, so that it is computed
    once per row and not once per lag.  NULL below two values.
    """
    squares = _total([f"coalesce((`{c}` - `{mean}`) * (`{c}` - `{mean}`), 0D)" for c in columns])
    n = _count(columns)
    return F.expr(f"case when {n} > 1 then sqrt({squares} / ({n} - 1)) end")
