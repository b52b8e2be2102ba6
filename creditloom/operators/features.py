"""Feature tables: aggregate detail rows to a key, then derive columns."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame


@dataclass(frozen=True)
class FeatureSpec:
    """``base`` aggregates detail rows; ``derived`` is computed from ``base``.

    Base aggregates should be numeric: then the aggregation is a hash
    aggregate with a partial, map-side step.
    """

    name: str
    base: Mapping[str, Column]
    derived: Mapping[str, Column]

    def summarise(self, detail: DataFrame, key: str = "loanId") -> DataFrame:
        return detail.groupBy(key).agg(*[c.alias(n) for n, c in self.base.items()])

    def table(self, detail: DataFrame, key: str = "loanId") -> DataFrame:
        return self.summarise(detail, key).select(
            key, *[c.alias(n) for n, c in self.derived.items()])
