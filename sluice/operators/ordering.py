"""Positions in an order without sorting the whole: the k-th row is found by narrowing ranges, each step one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a range that are sorted at last, and the accuracy of the percentiles that narrow it.
SMALL, ACCURACY = 100_000, 10_000


def literal(df: DataFrame, column: str, value) -> Column:
    """A value of a column as a literal of its type."""
    return F.lit(value if isinstance(value, (int, float)) else str(value)).cast(df.schema[column].dataType)


def nth(df: DataFrame, columns: list[str], k: int) -> tuple:
    """The values of the k-th row, from 0, in the order of number or time columns without nulls. Only bounds and counts come to
    the driver."""
    out = []
    for c in columns:
        value, below = _value_at(df, c, k)
        out.append(value)
        df, k = df.where(F.col(c) == literal(df, c, value)), k - below
    return tuple(out)


def _value_at(df: DataFrame, column: str, k: int) -> tuple:
    """The k-th smallest value and how many are smaller."""
    rows, below, c = df.select(column), 0, F.col(column)
    while True:
        n = rows.count()
        if n <= SMALL:
            value = rows.orderBy(column).limit(k - below + 1).agg(F.max(column)).first()[0]
            return value, below + rows.where(c < literal(df, column, value)).count()
        share, slack = (k - below) / n, 2 / ACCURACY
        low, high = rows.agg(F.percentile_approx(column, [max(0.0, share - slack), min(1.0, share + slack)], ACCURACY)).first()[0]
        lo, hi = literal(df, column, low), literal(df, column, high)
        less, first, upto = rows.agg(F.count_if(c < lo), F.count_if(c <= lo), F.count_if(c <= hi)).first()
        if k - below < less:
            rows = rows.where(c < lo)
        elif k - below < first:
            return low, below + less
        elif k - below < upto:
            rows, below = rows.where((c > lo) & (c <= hi)), below + first
        else:
            rows, below = rows.where(c > hi), below + upto
