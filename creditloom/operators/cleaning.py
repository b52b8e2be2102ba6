"""Cleaning: imputation, de-duplication and null profiles.

Statistics for all columns come from one aggregation. They reach the rows
through a one-row subquery inside the same plan, not through driver literals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from creditloom.operators.quantiles import column_percentiles


def _keys(by: str | None) -> list[str]:
    return [] if by is None else [by]


def fit_numeric(df: DataFrame, cols: Sequence[str], strategy: str = "approx_median",
                rel_err: float = 0.01, by: str | None = None) -> DataFrame:
    """Fill value per numeric column: rows ``(column, fill)``, per value of ``by`` if given.

    ``approx_median`` is the lower median within rank error ``rel_err``;
    ``rel_err=0`` makes it exact. ``median`` is the exact interpolated median.
    A column without values has no fill.
    """
    if strategy == "approx_median" and rel_err > 0:
        medians = df.groupBy(*_keys(by)).agg(*[
            F.percentile_approx(F.col(c).cast("double"), 0.5, round(1 / rel_err)).alias(c) for c in cols])
        return medians.unpivot(_keys(by), list(cols), "column", "fill")
    if strategy not in ("approx_median", "median"):
        raise ValueError(f"unknown strategy {strategy!r}")
    return column_percentiles(df, cols, 0.5, "fill", interpolate=strategy == "median", by=by)


def fit_mode(df: DataFrame, cols: Sequence[str], default: str = "Unknown", by: str | None = None) -> DataFrame:
    """Most frequent value per string column: rows ``(column, fill)``, per value of ``by`` if given.

    NULL competes as a value of its own; where it wins, the fill is
    ``default``. Ties go to a real value over NULL, then to the smallest.
    """
    typed = df.select(*_keys(by), *[F.col(c).cast("string").alias(c) for c in cols])
    counts = typed.unpivot(_keys(by), list(cols), "column", "value").groupBy(*_keys(by), "column", "value").count()
    best = F.min(F.struct((-F.col("count")).alias("neg"), F.col("value").isNull().alias("missing"),
                          F.col("value")))
    return (counts.groupBy(*_keys(by), "column").agg(best.alias("best"))
            .select(*_keys(by), "column", F.coalesce("best.value", F.lit(default)).alias("fill")))


def apply_fills(df: DataFrame, cols: Sequence[str], fills: DataFrame, dtype: str, by: str | None = None) -> DataFrame:
    """Replace NULL by the fitted value; every column in ``cols`` gets ``dtype``.

    With ``by``, a column of few values such as the split, each row takes the fills of its own.
    """
    if not cols:
        return df
    fitted = F.struct(*[F.max(F.when(F.col("column") == c, F.col("fill"))).alias(c) for c in cols])
    if by is None:
        values = fills.agg(fitted).scalar()
    else:
        groups = fills.groupBy(by).agg(fitted.alias("fits")).agg(F.map_from_entries(F.collect_list(F.struct(by, "fits"))))
        values = F.try_element_at(groups.scalar(), F.col(by))
    target = set(cols)
    held = next(n for n in map("fills{}".format, range(len(df.columns) + 1)) if n not in df.columns)
    return (df.withColumn(held, values)
            .select([F.coalesce(F.col(c).cast(dtype), F.col(f"{held}.`{c}`")).alias(c) if c in target else F.col(c)
                     for c in df.columns]))


def impute_numeric(df: DataFrame, cols: Sequence[str], strategy: str = "approx_median",
                   rel_err: float = 0.01, fit_on: DataFrame | None = None, by: str | None = None) -> DataFrame:
    """Median imputation; the columns become double whether or not they had NULLs."""
    if not cols:
        return df
    return apply_fills(df, cols, fit_numeric(fit_on or df, cols, strategy, rel_err, by), "double", by)


def impute_mode(df: DataFrame, cols: Sequence[str], default: str = "Unknown",
                fit_on: DataFrame | None = None, by: str | None = None) -> DataFrame:
    """Mode imputation of string columns."""
    if not cols:
        return df
    return apply_fills(df, cols, fit_mode(fit_on or df, cols, default, by), "string", by)


def dedup_by_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """One row per key: the smallest in the order given, ties broken by the remaining columns.

    One exchange by key; each task drops all but the first row of a key before
    it, so a key with very many rows is not gathered.
    """
    order = [*order_by, *[c for c in df.columns if c not in order_by and c not in keys]]
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*(order or keys)))
    number = next(n for n in map("nth{}".format, range(len(df.columns) + 1)) if n not in df.columns)
    return df.withColumn(number, nth).where(F.col(number) == 1).drop(number)


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.distinct()


def null_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """NULL count of every column, from one pass over the data."""
    names = list(cols or df.columns)
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in names])
    return counts.unpivot([], names, "column", "n_null")
