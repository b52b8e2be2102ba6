"""Exact quantiles without gathering many values in one task.

The built-in exact percentile keeps all distinct values of a group in one
aggregation buffer, which is right for groups of at most ``DIRECT`` values. The
wanted ranks of larger groups are found by radix selection: a pass counts the values
of each group by a digit that grows with the value, and the digit that holds the rank
becomes the next pass's range, until the range is one value. The first digit is the
size on a logarithmic scale, later ones are equal parts of the range, so that five
passes fix what two or three don't. A pass moves at most ``PARTS + 1`` counts per range
and task (the first 126,000 per group if values of all sizes and signs occur), whatever
the number of values or the share of one of them, and only values in the range are
looked at again. Each pass is a job of its own: what it leaves, two ranges a group, goes
to the shared scratch folder. Nothing is estimated.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.session import scratch_path

DIRECT = 20_000               # values of a group that an aggregation buffer may hold
DIRECT_CELLS = 2_000_000      # values of all columns of a frame
OCTAVE, END = 30, 2 ** 17      # first digits of an octave; those of the infinities
PARTS = 8_192                 # of a range, in later passes


def exact_percentile(df: DataFrame, dims: Sequence[str], value: str, p: float = 0.5,
                     name: str = "percentile", interpolate: bool = True) -> DataFrame:
    """Exact ``p``-quantile of ``value`` per combination of ``dims``, however many there are.

    ``interpolate=True`` is the continuous quantile, ``False`` the smallest
    value whose rank reaches ``p``. NULL is a dimension value like any other. A
    group without values has no row. Whether there are groups above ``DIRECT`` values
    is looked up first. For many columns of one frame ``column_percentiles`` reads
    them side by side.
    """
    group = F.struct(*[F.col(d) for d in dims]) if dims else F.struct(F.lit(0).alias("all"))
    data = (df.select(group.alias("g"), F.col(value).cast("double").alias("v"))
              .where(F.col("v").isNotNull()))
    large = data.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > DIRECT).select("g")

    def direct(rows: DataFrame) -> DataFrame:
        return rows.groupBy("g").agg(_built_in("v", p, interpolate).alias("q"))

    if large.isEmpty():
        picked = direct(data)
    else:
        # Structs compare their NULL fields as equal, so these joins are null-safe.
        picked = direct(data.join(large, "g", "left_anti")).unionByName(
            _select(data.join(large, "g", "left_semi"), data, p, interpolate))
    return picked.select(*[F.col(f"g.{d}").alias(d) for d in dims], F.col("q").alias(name))


def column_percentiles(df: DataFrame, cols: Sequence[str], p: float = 0.5, name: str = "percentile",
                       interpolate: bool = True, by: str | None = None) -> DataFrame:
    """Exact ``p``-quantile of each column: rows ``(column, <name>)``, per value of ``by`` if given.

    All columns are read side by side. The size of the frame decides between one
    aggregation and the passes of radix selection. A column without values has no row.
    """
    keys = [] if by is None else [by]
    typed = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols])
    if typed.count() * len(cols) <= DIRECT_CELLS:
        wide = typed.groupBy(*keys).agg(*[_built_in(c, p, interpolate).alias(c) for c in cols])
        return wide.unpivot(keys, list(cols), "column", name).where(F.col(name).isNotNull())
    long = typed.unpivot(keys, list(cols), "column", "v").where(F.col("v").isNotNull())
    data = long.select(F.struct(*keys, "column").alias("g"), "v")
    return _select(data, data, p, interpolate).select(*[F.col(f"g.{k}").alias(k) for k in keys],
                                                      F.col("g.column").alias("column"), F.col("q").alias(name))


def _built_in(col: str, p: float, interpolate: bool) -> Column:
    return F.expr(f"percentile_{'cont' if interpolate else 'disc'}({p}D) WITHIN GROUP (ORDER BY `{col}`)")


def _first_digit(v: Column) -> Column:
    """A number that grows with the value: 30 an octave (the logarithm never falls as its argument grows)."""
    size = F.floor((F.log2(F.abs(v)) + 1075) * OCTAVE)
    finite = F.when(v == 0, F.lit(0).cast("long")).when(v > 0, size).otherwise(-size)
    return (F.when(F.isnan(v), END + 1).when(v == F.lit(float("inf")), END).when(v == F.lit(float("-inf")), -END)
            .otherwise(finite))


def _spread(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per range: its number of values and, in order, its digits with their number, least and greatest value."""
    counts = rows.groupBy(*keys, "digit").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    return counts.groupBy(*keys).agg(F.sum("n").alias("total"), F.sort_array(F.collect_list(
        F.struct("digit", "n", "low", "high"))).alias("digits"))


def _narrowed(targets: DataFrame) -> DataFrame:
    """The digit that holds each target's rank as its range, with the rank there."""
    kind = "struct<seen: bigint, k: bigint, low: double, high: double>"
    start = F.struct(F.lit(0), F.lit(None), F.lit(None), F.lit(None)).cast(kind)

    def step(s: Column, d: Column) -> Column:
        seen = s["seen"] + d["n"]
        here = (F.col("k") >= s["seen"]) & (F.col("k") < seen)
        return F.when(here, F.struct(seen, F.col("k") - s["seen"], d["low"], d["high"]).cast(kind)).otherwise(
            F.struct(seen, s["k"], s["low"], s["high"]).cast(kind))

    found = targets.select("g", "side", "share", F.aggregate("digits", start, step).alias("at"))
    return found.select("g", "side", "share", "at.k", "at.low", "at.high")


def _stored(ranges: DataFrame) -> DataFrame:
    """Written and read back, so that a pass is a job of its own and no later one repeats it."""
    path = scratch_path(ranges.sparkSession, "ranges")
    ranges.write.parquet(path)
    return ranges.sparkSession.read.schema(ranges.schema).parquet(path)


def _select(first: DataFrame, data: DataFrame, p: float, interpolate: bool) -> DataFrame:
    """Quantile ``q`` of each group ``g`` in ``first``; later passes look at ``data`` only within ranges.

    A target is a rank ``k`` among the values of its range, with the side (0 the wanted rank
    or below, 1 above) and the share of the upper side.
    """
    spread = _spread(first.withColumn("digit", _first_digit(F.col("v"))), ["g"])
    rank = F.lit(p) * (F.col("total") - 1) if interpolate else F.greatest(F.ceil(F.lit(p) * F.col("total")) - 1, F.lit(0))
    share = (rank - F.floor(rank)).cast("double").alias("share")
    sides = F.array(*[F.struct(F.lit(i).alias("side"), r.cast("long").alias("k"), share)
                      for i, r in enumerate((F.floor(rank), F.ceil(rank)))])
    needed = F.filter(sides, lambda s: (s["side"] == 0) | (s["share"] > 0))
    ranges = _stored(_narrowed(spread.select("g", "digits", F.inline(needed))))
    found = [ranges.where("low = high")]
    while not (open_ := ranges.where("low < high").withColumnsRenamed({"low": "start", "high": "end"})).isEmpty():
        # Several targets may lie in one range; its values are counted once.
        inside = data.join(open_.select("g", "start", "end").distinct(), "g").where(F.col("v").between(F.col("start"), F.col("end")))
        digit = F.floor((F.col("v") - F.col("start")) / (F.col("end") - F.col("start")) * PARTS).alias("digit")
        spread = _spread(inside.select("g", "start", digit, "v"), ["g", "start"])
        ranges = _stored(_narrowed(open_.join(spread, ["g", "start"])))
        found.append(ranges.where("low = high"))
    side = [F.max(F.when(F.col("side") == i, F.col("low"))) for i in (0, 1)]
    share = F.max("share")
    return reduce(DataFrame.unionByName, found).groupBy("g").agg(
        F.when(share == 0, side[0]).otherwise(side[0] + (side[1] - side[0]) * share).alias("q"))
