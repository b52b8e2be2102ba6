"""Report operators: rates by dimension, comparisons by label, extremes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def target_rate(df: DataFrame, dims: Mapping[str, Column | str] | Sequence[str],
                target: str = "target", extra: Mapping[str, Column] | None = None,
                weight: str | None = None, order: Sequence[Column] | None = None,
                count_name: str = "total", rate_name: str = "default_rate") -> DataFrame:
    """Row count and average label per dimension combination, highest rate first.

    ``weight`` names a column telling how many rows each row stands for, so
    a pre-aggregated input gives the same table as its detail rows.
    """
    named = dims if isinstance(dims, Mapping) else {d: d for d in dims}
    keys = [(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in named.items()]
    if weight is None:
        count, rate = F.count(F.lit(1)), F.avg(target)
    else:
        w = F.col(weight)
        count = F.sum(w)
        rate = F.try_divide(F.sum(w * F.col(target)).cast("double"),
                            F.sum(F.when(F.col(target).isNotNull(), w)).cast("double"))
    extras = [c.alias(n) for n, c in (extra or {}).items()]
    report = df.groupBy(*keys).agg(count.alias(count_name), rate.alias(rate_name), *extras)
    return report.orderBy(*(order or [F.col(rate_name).desc_nulls_last(), *[F.col(n) for n in named]]))


def rates_in_one_scan(df: DataFrame, reports: Mapping[str, Mapping[str, Column | str] | Sequence[str]],
                      target: str = "target") -> DataFrame:
    """Row count and average label of several reports from one read of ``df``.

    All dimensions are derived once and grouped by one set per report; each task folds its rows
    before anything is exchanged. Rows carry the ``report`` they belong to and its dimensions;
    those of other reports are NULL. ``report_of`` gives one of them.
    """
    sets = {name: dict(dims) if isinstance(dims, Mapping) else {d: d for d in dims} for name, dims in reports.items()}
    named = {n: F.col(c) if isinstance(c, str) else c for dims in sets.values() for n, c in dims.items()}
    derived = df.select(*[c.alias(n) for n, c in named.items()], F.col(target).alias("label"))
    which = F.grouping_id(*[F.col(n) for n in named])
    grouped = derived.groupingSets([[F.col(n) for n in dims] for dims in sets.values()], *[F.col(n) for n in named]).agg(
        which.alias("which"), F.count(F.lit(1)).alias("total"), F.avg("label").alias("default_rate"))
    ids = {sum(1 << (len(named) - 1 - i) for i, n in enumerate(named) if n not in dims): name for name, dims in sets.items()}
    if len(ids) < len(sets):
        raise ValueError("two reports have the same dimensions")
    label = reduce(lambda when, item: when.when(F.col("which") == item[0], item[1]), ids.items(), F)
    return grouped.select(label.alias("report"), *named, "total", "default_rate")


def report_of(reports: DataFrame, name: str, dims: Sequence[str], order: Sequence[Column] | None = None) -> DataFrame:
    """One report of ``rates_in_one_scan``, highest rate first."""
    rows = reports.where(F.col("report") == name).select(*dims, "total", "default_rate")
    return rows.orderBy(*(order or [F.col("default_rate").desc_nulls_last(), *dims]))


def compare_by_target(df: DataFrame, metrics: Mapping[str, Column], target: str = "target") -> DataFrame:
    """Mean of each metric per label value."""
    return df.groupBy(target).agg(*[F.avg(c).alias(n) for n, c in metrics.items()])


def top_k(df: DataFrame, by: Column | str, k: int, desc: bool = True, *,
          tie_break: Sequence[str]) -> DataFrame:
    """The ``k`` extreme rows; each task keeps ``k`` rows at most.

    ``tie_break`` columns decide which of equal rows are among them.
    """
    column = F.col(by) if isinstance(by, str) else by
    lead = column.desc_nulls_last() if desc else column.asc_nulls_last()
    return df.orderBy(lead, *tie_break).limit(k)


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
