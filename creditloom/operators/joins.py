"""Join-shaped operators. All keys are equi-keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.operators.features import FeatureSpec


def join_detail(parent: DataFrame, child: DataFrame, key: str) -> DataFrame:
    """Left join that keeps every child row of a parent (fan-out).

    Adaptive execution can split a hot child key only in an inner join, so
    matched, unmatched and keyless parents are planned apart; the anti join
    sees each child key once.
    """
    keyed, keyless = _by_key_presence(parent, key)
    matched = keyed.join(child, key, "inner")
    unmatched = keyed.join(child.select(key).distinct(), key, "left_anti")
    return (matched.unionByName(unmatched, allowMissingColumns=True)
            .unionByName(keyless, allowMissingColumns=True))


def join_summary(parent: DataFrame, child: DataFrame, key: str, aggs: Sequence[Column]) -> DataFrame:
    """Reduce the child to one row per key, then left join: no fan-out, no hot child key."""
    keyed, keyless = _by_key_presence(parent, key)
    joined = keyed.join(child.groupBy(key).agg(*aggs), key, "left")
    return joined.unionByName(keyless, allowMissingColumns=True)


def _by_key_presence(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows with and without a key.

    All NULL keys hash to one partition though none can match, so they go
    around the join. Where the source has none, file statistics skip the scan.
    """
    return df.where(F.col(key).isNotNull()), df.where(F.col(key).isNull())


def fan_in(base: DataFrame, features: Sequence[DataFrame], key: str) -> DataFrame:
    """Left join of one-row-per-key feature tables onto the entity table.

    All joins share the key, so the base is exchanged once and aggregated
    features not at all.
    """
    return reduce(lambda left, right: left.join(right, key, "left"), features, base)


def full_outer_merge(features: Sequence[DataFrame], key: str) -> DataFrame:
    """Full outer join of the feature tables on a coalesced key."""
    return reduce(lambda left, right: left.join(right, key, "full"), features)


def union_merge(parts: Sequence[tuple[FeatureSpec, DataFrame]], key: str) -> DataFrame:
    """The full outer merge of aggregated feature tables as one aggregation.

    Each part is (spec, detail rows). The primitive aggregates of all parts
    are stacked and folded by key; derived columns are computed last and stay
    NULL for keys the part does not have. As in a full join, NULL keys of
    different parts do not meet.
    """
    stacked = []
    for i, (spec, detail) in enumerate(parts):
        stacked.append(spec.summarise(detail).withColumns({
            f"has_{spec.name}": F.lit(1),
            "null_slot": F.when(F.col(key).isNull(), F.lit(i)),
        }))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), stacked)
    folded = rows.groupBy(key, "null_slot").agg(
        *[F.max(c).alias(c) for c in rows.columns if c not in (key, "null_slot")])
    return folded.select(key, *[
        F.when(F.col(f"has_{spec.name}") == 1, column).alias(name)
        for spec, _ in parts for name, column in spec.derived.items()])


def cardinality_check(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Row and key counts on both sides of a join that must not change them."""
    def totals(df: DataFrame, side: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(key).alias("n_keys")
                      ).withColumn("side", F.lit(side))

    both = totals(before, "before").unionByName(totals(after, "after"))

    def of(side: str, col: str):
        return F.max(F.when(F.col("side") == side, F.col(col)))

    return both.agg(
        of("before", "n_rows").alias("rows_before"), of("after", "n_rows").alias("rows_after"),
        of("before", "n_keys").alias("keys_before"), of("after", "n_keys").alias("keys_after"),
    ).withColumn("preserved", (F.col("rows_before") == F.col("rows_after"))
                 & (F.col("keys_before") == F.col("keys_after")))


def assert_cardinality(before: DataFrame, after: DataFrame, key: str) -> None:
    row = cardinality_check(before, after, key).first()
    if not row.preserved:
        raise ValueError(f"join changed the cardinality: {row.asDict()}")
