"""Projection-shaped operators: renames, defaults, tags and schema repair."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditloom.functions import flag


def rename_project(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Keep the mapped columns only, under their new names."""
    return df.select([F.col(src).alias(dst) for src, dst in names.items()])


def present(df: DataFrame, cols: Iterable[str], partial: bool) -> list[str]:
    """The columns that the frame has; missing ones are an error unless ``partial``."""
    have = set(df.columns)
    missing = [c for c in cols if c not in have]
    if missing and not partial:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return [c for c in cols if c in have]


def encode_flag(df: DataFrame, cols: Sequence[str], true: str = "Y", partial: bool = False) -> DataFrame:
    """Yes/no strings to 1/0; NULL and anything else is 0."""
    return df.withColumns({c: flag(F.col(c) == true).cast("int") for c in present(df, cols, partial)})


def sentinel(df: DataFrame, col: str, value, repl, years, indicator: str, out: str) -> DataFrame:
    """Replace a sentinel by ``repl`` in ``out`` and keep a 0/1 indicator of it."""
    hit = F.col(col) == value
    return df.withColumns({out: F.when(hit, F.lit(repl)).otherwise(years), indicator: flag(hit)})


def fill_defaults(df: DataFrame, defaults: Mapping[str, object], partial: bool = False) -> DataFrame:
    """Per-column replacement of NULL."""
    fills = {c: defaults[c] for c in present(df, list(defaults), partial)}
    return df.na.fill(fills) if fills else df


def tag(df: DataFrame, name: str, value) -> DataFrame:
    return df.withColumn(name, F.lit(value))


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    """Any ``n`` rows."""
    return df.limit(n)


def columns_by_type(df: DataFrame, types: Sequence[str] = ("double", "int", "float"),
                    exclude: Sequence[str] = ()) -> list[str]:
    return [c for c, t in df.dtypes if t in types and c not in exclude]


def align_schema(df: DataFrame, expected: T.StructType) -> DataFrame:
    """Project to ``expected``: missing columns become typed NULLs, extras go."""
    have = set(df.columns)
    return df.select([
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in expected.fields
    ])


def schema_diff(df: DataFrame, expected: T.StructType) -> DataFrame:
    """One row per column of either schema with its drift status."""
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    want = {f.name: f.dataType.simpleString() for f in expected.fields}

    def status(name: str) -> str:
        if name not in want:
            return "added"
        if name not in have:
            return "missing"
        return "ok" if have[name] == want[name] else "type_changed"

    rows = [(name, want.get(name), have.get(name), status(name)) for name in sorted({*have, *want})]
    return df.sparkSession.createDataFrame(
        rows, "column string, expected_type string, actual_type string, status string")


def union_splits(train: DataFrame, test: DataFrame, label: str = "target") -> DataFrame:
    """Train and test in one frame; the test label is a typed NULL."""
    unlabelled = test.withColumn(label, F.lit(None).cast("double"))
    return train.unionByName(unlabelled, allowMissingColumns=True)
