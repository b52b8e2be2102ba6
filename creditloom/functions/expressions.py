"""Row-level column expressions.

Everything here returns a built-in ``Column`` expression, so it stays inside
whole-stage codegen. Divisions and string casts use the ``try_`` forms: under
ANSI mode a plain ``/`` by zero or a cast of a letter code fails the job.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str
DAYS_PER_YEAR = 365.25


def _c(x: ColumnLike) -> Column:
    return F.col(x) if isinstance(x, str) else x


def flag(pred: Column) -> Column:
    """1 where the predicate holds, else 0; an unknown predicate counts as 0."""
    return F.when(pred, 1).otherwise(0)


def ratio(num: ColumnLike, den: ColumnLike, on_zero: float | None = 0.0) -> Column:
    """``num / den`` as double; a zero denominator gives ``on_zero``.

    A NULL on either side gives NULL whatever ``on_zero`` is.
    """
    quotient = F.try_divide(_c(num).cast("double"), _c(den).cast("double"))
    if on_zero is None:
        return quotient
    return F.when(_c(den) == 0, F.lit(float(on_zero))).otherwise(quotient)


def days_to_years(days: ColumnLike, mode: str = "round", digits: int = 0) -> Column:
    """Day offset from the application date (negative = past) to years.

    ``mode='floor'`` gives completed years, ``mode='round'`` rounds half up to
    ``digits``; whole years are integers, anything else is double.
    """
    years = F.abs(_c(days)) / F.lit(DAYS_PER_YEAR)
    if mode == "floor":
        return F.floor(years)
    if mode != "round":
        raise ValueError(f"unknown mode {mode!r}")
    rounded = F.round(years, digits)
    return rounded.cast("int") if digits == 0 else rounded


def between_flag(col: ColumnLike, lo, hi) -> Column:
    """1 inside the closed range, else 0."""
    return flag(_c(col).between(lo, hi))


def like_flag(col: ColumnLike, pattern: str) -> Column:
    return flag(_c(col).like(pattern))


def map_groups(col: ColumnLike, groups: Mapping[str, Sequence[str]], default: str) -> Column:
    """Label of the first group that lists the value; NULL takes the default."""
    return bucketize([(_c(col).isin(list(members)), label) for label, members in groups.items()],
                     default)


def bucketize(rules: Sequence[tuple[Column, str]], default: str | None) -> Column:
    """First matching rule wins."""
    chain = F
    for pred, label in rules:
        chain = chain.when(pred, F.lit(label))
    return chain.otherwise(F.lit(default))


def cross_profile(a: ColumnLike, b: ColumnLike, labels: Mapping[tuple[int, int], str],
                  default: str) -> Column:
    """Label for each combination of two 0/1 flags."""
    return bucketize([((_c(a) == x) & (_c(b) == y), label) for (x, y), label in labels.items()],
                     default)


def score_conditions(*preds: Column) -> Column:
    """How many of the predicates hold; an unknown predicate adds nothing."""
    return reduce(add, [flag(p) for p in preds])


def sum_flags(cols: Sequence[ColumnLike]) -> Column:
    """Plain sum of flags; NULL as soon as one flag is NULL."""
    return reduce(add, [_c(c) for c in cols])


def code_to_int(col: ColumnLike, valid: Sequence[str] | None = None,
                other: int | None = 0) -> Column:
    """Digit status code to int; codes outside ``valid`` become ``other``.

    Without ``valid`` every digit code converts and letters give NULL.
    """
    number = _c(col).try_cast("int")
    if valid is None:
        return number
    return F.when(_c(col).isin(list(valid)), number).otherwise(F.lit(other))


def coalesce_key(*cols: ColumnLike) -> Column:
    return F.coalesce(*[_c(c) for c in cols])


def diff(a: ColumnLike, b: ColumnLike) -> Column:
    return _c(a) - _c(b)
