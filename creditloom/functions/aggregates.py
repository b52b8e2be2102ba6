"""Conditional aggregate expressions.

All of them reduce to sum/min/max/avg over primitive buffers, so they combine
map-side in a hash aggregate and a hot key never reaches one task unreduced.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from creditloom.functions.expressions import ColumnLike, _c, flag, ratio


def count_if(pred: Column) -> Column:
    """Rows where the predicate holds; 0 when there are none."""
    return F.count_if(pred)


def any_flag(pred: Column) -> Column:
    """1 if the predicate holds in any row of the group, else 0."""
    return F.max(flag(pred))


def all_flag(pred: Column) -> Column:
    """1 if the predicate holds in every row of the group, else 0."""
    return F.min(flag(pred))


def avg_where(value: ColumnLike, pred: Column, els: float | None = None) -> Column:
    """Average over the rows that satisfy ``pred``.

    ``els=0`` keeps the other rows in the denominator as zeros; the default
    leaves them out and yields NULL for a group with no match.
    """
    picked = F.when(pred, _c(value))
    return F.avg(picked if els is None else picked.otherwise(F.lit(els)))


def span(col: ColumnLike) -> Column:
    return F.max(_c(col)) - F.min(_c(col))


def share(pred: Column) -> Column:
    """Share of rows where the predicate holds, as double."""
    return ratio(F.count_if(pred), F.count(F.lit(1)), on_zero=0.0)


def pct_share(pred: Column, digits: int = 2) -> Column:
    return F.round(F.lit(100.0) * share(pred), digits)


def weighted_avg(value: ColumnLike, weight: ColumnLike) -> Column:
    """Average of ``value`` over rows that each stand for ``weight`` rows.

    Rows with a NULL value leave the denominator, as in AVG.
    """
    v, w = _c(value), _c(weight)
    return F.try_divide(F.sum(v * w).cast("double"),
                        F.sum(F.when(v.isNotNull(), w)).cast("double"))
