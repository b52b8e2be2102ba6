"""Fits kept as mergeable sketches, so that new data refines them without rereading the old.

A quantile sketch per column is made for each split or day and stored; merging the
stored ones gives the sketch of all rows. Heavy-hitter sketches propose the values that
may be a column's mode; only those are counted exactly.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.operators.cleaning import fit_mode


def sketch_size(rel_err: float) -> int:
    """The k of a KLL sketch whose rank error stays below ``rel_err`` (99 of 100 times; the usual fit)."""
    return min(65_535, max(8, math.ceil((2.296 / rel_err) ** (1 / 0.9021))))


def fit_sketches(df: DataFrame, cols: Sequence[str], rel_err: float = 0.01, by: Sequence[str] = ()) -> DataFrame:
    """Rows ``(by.., column, n, sketch)``, from one aggregation; to be stored and merged later."""
    size = F.lit(sketch_size(rel_err))
    wide = df.groupBy(*by).agg(*[F.struct(F.count(c).alias("n"), F.kll_sketch_agg_double(F.col(c).cast("double"), size)
                                          .alias("sketch")).alias(c) for c in cols])
    return wide.unpivot(list(by), list(cols), "column", "fit").select(*by, "column", "fit.n", "fit.sketch")


def merge_sketches(fits: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per column, and per value of ``by``, for the rows of all given fits."""
    return (fits.where("n > 0").groupBy(*by, "column")
            .agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch")))


def sketch_quantiles(fits: DataFrame, p: float = 0.5, name: str = "fill") -> DataFrame:
    """``(by.., column, <name>)``; a column without values has no row."""
    keys = [c for c in fits.columns if c not in ("n", "sketch")]
    return fits.where("n > 0").select(*keys, F.kll_sketch_get_quantile_double("sketch", F.lit(p)).alias(name))


#: Values that a heavy-hitter sketch follows, and candidates that it proposes.
TRACKED, CANDIDATES = 10_000, 32


def fit_mode_of_many(df: DataFrame, cols: Sequence[str], default: str = "Unknown",
                     tracked: int = TRACKED, candidates: int = CANDIDATES) -> DataFrame:
    """``fit_mode`` for columns of very many values, without an exchange of them.

    One pass proposes candidates by sketch, a second one counts these exactly. Where the
    sketch's error bound leaves room for a value that was not proposed, as in a column of
    unique values, the column is counted in full.
    """
    if not cols:
        return fit_mode(df, cols, default)
    typed = df.select([F.col(c).cast("string").alias(c) for c in cols])
    map_size = 2 ** math.ceil(math.log2(max(8, tracked / 0.75)))
    first = typed.agg(F.count("*").alias("rows"), *[F.struct(
        F.count(c).alias("n"), F.expr(f"approx_top_k(`{c}`, {candidates}, {tracked})").alias("top")).alias(c) for c in cols]).first()
    counts, bounds = [], {}
    for c in cols:
        top = [(t.item, t["count"]) for t in first[c].top if t.item is not None]
        counts += [F.count_if(F.col(c) == value).alias(f"{len(counts)}") for value, _ in top]
        error = math.ceil(3.5 * first[c].n / map_size) if first[c].n > 0.75 * map_size else 0
        bounds[c] = [value for value, _ in top], error + (top[-1][1] if len(top) == candidates else 0)
    exact = typed.agg(*counts).first() if counts else []
    fits, full, at = [], [], 0
    for c in cols:
        values, bound = bounds[c]
        found = list(zip(exact[at:at + len(values)], values))
        at += len(values)
        missing = first.rows - first[c].n
        best = max([n for n, _ in found], default=0)
        if max(best, missing) <= bound:
            full.append(c)
        else:
            fill = min((v for n, v in found if n == best), key=str.encode, default=None)
            fits.append((c, fill if best and best >= missing else default))
    fitted = df.sparkSession.createDataFrame(fits, "column string, fill string")
    return fitted.unionByName(fit_mode(df, full, default)) if full else fitted


def fingerprint(columns: Sequence[str]) -> list[Column]:
    """128 bits over all values of a row and where they are NULL."""
    absent = [F.col(f"`{c}`").isNull() for c in columns]
    values = [F.col(f"`{c}`") for c in columns]
    return [F.xxhash64(*absent, *values).alias("f0"), F.xxhash64(F.lit(1), *values, *absent).alias("f1")]


#: Repeated fingerprints that are broadcast, 16 bytes each.
FEW_REPEATED = 50_000


def distinct_of_mostly_unique(df: DataFrame, most: int = FEW_REPEATED, by: Sequence[str] | None = None) -> DataFrame:
    """``distinct`` that moves only rows whose fingerprint occurs again.

    Fingerprints are counted first, in an exchange of 16 bytes a row. If at most ``most`` of them
    repeat, they are broadcast: all other rows stay where they are and only the repeated ones are
    compared in full. Otherwise the whole frame goes through ``distinct``. With ``by``, columns
    that rarely hold the same values twice, the fingerprint is that of these, and only they are
    read to count it; equal rows agree in them.
    """
    marks = fingerprint(by or df.columns)
    counted = df.select(*marks).groupBy("f0", "f1").count()
    # Collected as one row: a bare limit would run a few partitions at a time.
    few = counted.where("count > 1").limit(most + 1).agg(F.collect_list(F.struct("f0", "f1")).alias("few")).first().few
    if not few or len(few) > most:
        return df.distinct() if few else df
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    known = F.broadcast(df.sparkSession.createDataFrame(few, "f0 long, f1 long"))
    rows = df.select(*marks, whole)
    alone = rows.join(known, ["f0", "f1"], "left_anti").select("row.*")
    return alone.unionByName(rows.join(known, ["f0", "f1"], "left_semi").select("row.*").distinct())
