"""Data-quality expectations: one pass over the table, one row per expectation."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from creditloom.sources.layers import read_path, replace_path, write_layer


@dataclass(frozen=True)
class Expectation:
    kind: str
    column: str
    unexpected: Column

    def __repr__(self) -> str:
        return f"{self.kind}({self.column})"


def expect_not_null(col: str) -> Expectation:
    return Expectation("not_null", col, F.count_if(F.col(col).isNull()))


def expect_unique(col: str) -> Expectation:
    """Rows beyond the distinct non-NULL values; a NULL key counts against it."""
    return Expectation("unique", col, F.count(F.lit(1)) - F.count_distinct(col))


def expect_in_set(col: str, values: Sequence) -> Expectation:
    """NULL passes."""
    return Expectation("in_set", col, F.count_if(~F.col(col).isin(list(values))))


def expect_between(col: str, lo, hi) -> Expectation:
    """Closed range; NULL passes."""
    return Expectation("between", col, F.count_if((F.col(col) < lo) | (F.col(col) > hi)))


# Names under which suites on disk list their expectations (fixed values).
SUITE_TYPES = {
    "expect_column_values_to_not_be_null": lambda k: expect_not_null(k["column"]),
    "expect_column_values_to_be_unique": lambda k: expect_unique(k["column"]),
    "expect_column_values_to_be_in_set": lambda k: expect_in_set(k["column"], k["value_set"]),
    "expect_column_values_to_be_between":
        lambda k: expect_between(k["column"], k["min_value"], k["max_value"]),
}


def load_suite(text: str | Mapping) -> list[Expectation]:
    """Suite from its JSON form."""
    suite = json.loads(text) if isinstance(text, str) else text
    return [SUITE_TYPES[e["expectation_type"]](e["kwargs"]) for e in suite["expectations"]]


def validate(df: DataFrame, suite: Sequence[Expectation]) -> DataFrame:
    """Result rows ``(step, expectation, column, n_rows, n_unexpected, success)``.

    The last row, ``suite``, is the overall verdict.
    """
    counters = df.agg(F.count(F.lit(1)).alias("n_rows"),
                      *[e.unexpected.alias(f"e{i}") for i, e in enumerate(suite)])
    return _verdict(counters, suite)


def _verdict(counters: DataFrame, suite: Sequence[Expectation]) -> DataFrame:
    def result(step: int, kind: str, column: str | None, count: Column) -> Column:
        return F.struct(F.lit(step).alias("step"), F.lit(kind).alias("expectation"),
                        F.lit(column).cast("string").alias("column"),
                        F.col("n_rows"), count.cast("long").alias("n_unexpected"),
                        (count == 0).alias("success"))

    rows = [result(i, e.kind, e.column, F.col(f"e{i}")) for i, e in enumerate(suite)]
    failed = sum((F.when(F.col(f"e{i}") > 0, 1).otherwise(0) for i in range(len(suite))), F.lit(0))
    rows.append(result(len(suite), "suite", None, failed))
    return counters.select(F.inline(F.array(*rows)))


class WriteChecks:
    """A suite whose counts are taken while the rows are written.

    Write ``measured``, then ask for the ``result`` on what was written: only uniqueness
    is not a running count and reads its key columns once more.
    """

    def __init__(self, df: DataFrame, suite: Sequence[Expectation]):
        self.suite, self.seen = list(suite), Observation()
        self.running = {f"e{i}": e.unexpected for i, e in enumerate(self.suite) if e.kind != "unique"}
        self.measured = df.observe(self.seen, F.count(F.lit(1)).alias("n_rows"),
                                   *[c.alias(n) for n, c in self.running.items()])

    def result(self, written: DataFrame) -> DataFrame:
        """The rows that ``validate`` returns for ``written``."""
        counted = {n: F.lit(v).cast("long").alias(n) for n, v in self.seen.get.items()}
        later = {f"e{i}": e.unexpected for i, e in enumerate(self.suite) if f"e{i}" not in counted}
        counters = (written.agg(*[c.alias(n) for n, c in later.items()]) if later
                    else written.sparkSession.range(1)).select("*", *counted.values())
        return _verdict(counters, self.suite)


class ValidationError(Exception):
    pass


def gate(result: DataFrame) -> None:
    """Raise unless every expectation holds."""
    failed = result.where(~F.col("success") & (F.col("expectation") != "suite")).collect()
    if failed:
        raise ValidationError("; ".join(
            f"{r.expectation}({r['column']}): {r.n_unexpected} of {r.n_rows}" for r in failed))


def key_audit(df: DataFrame, key: str) -> DataFrame:
    """Rows, NULL keys and repeated keys in one aggregation."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.count_if(F.col(key).isNull()).alias("n_null"),
                  (F.count(key) - F.count_distinct(key)).alias("n_duplicate"))


def promote(df: DataFrame, suite: Sequence[Expectation], path: str, staging: str,
            files: int | None = None) -> DataFrame:
    """Stage, gate on the checks taken while staging, and only then move to the final path."""
    checks = WriteChecks(df, suite)
    write_layer(checks.measured, staging, files)
    gate(checks.result(read_path(df.sparkSession, staging)))
    replace_path(df.sparkSession, staging, path)
    return read_path(df.sparkSession, path)
