"""Landing CSV whose headers or fields are not as registered.

Headers are compared by name before any typed read, file by file. Rows are then read as
text under their own file's header and cast column by column: what casts lands with the
registered schema, what does not goes to a quarantine table with column and reason. An
added column is left out and a lost one is NULL; both are in the drift record.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


CORRUPT = "_corrupt"


def _first_lines(batches):
    """The first row of each file; what follows in the task is not looked at."""
    last = None
    for batch in batches:
        names = batch.column("file").to_pylist()
        new = [i for i, name in enumerate(names) if name != (names[i - 1] if i else last)]
        last = names[-1] if names else last
        if new:
            yield pa.Table.from_batches([batch]).take(new).combine_chunks().to_batches()[0]


def headers(spark: SparkSession, path: str) -> DataFrame:
    """``(file, path, columns)`` of every CSV file below a folder or of one file."""
    lines = spark.read.option("recursiveFileLookup", True).text(path).where("_metadata.file_block_start = 0")
    rows = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"),
                        F.col("value").alias("header"))
    first = rows.mapInArrow(_first_lines, "path string, file string, header string")
    return first.select("file", "path", F.split(F.regexp_replace("header", '["\\r\\ufeff]', ""), ",").alias("columns"))


def drift(found: DataFrame, schema: T.StructType) -> DataFrame:
    """``(file, column, status)`` where a header is not as registered: ``added``, ``missing``, ``repeated`` or ``moved``."""
    want = F.array(*[F.lit(f.name) for f in schema.fields])
    shared = F.array_intersect("columns", want)
    in_order = shared == F.array_intersect(want, F.col("columns"))
    cases = [("added", F.array_except("columns", want)), ("missing", F.array_except(want, F.col("columns"))),
             ("repeated", F.array_distinct(F.filter("columns", lambda c: F.size(F.filter("columns", lambda d: d == c)) > 1))),
             ("moved", F.when(in_order, F.array().cast("array<string>")).otherwise(
                 F.filter(shared, lambda c: F.array_position(shared, c)
                          != F.array_position(F.array_intersect(want, F.col("columns")), c))))]

    def listed(status: str, columns: Column) -> Column:
        return F.transform(columns, lambda c: F.struct(c.alias("column"), F.lit(status).alias("status")))

    return found.select("file", F.inline(F.concat(*[listed(*case) for case in cases])))


def record_drift(table: str, drifted: DataFrame, history: str) -> int:
    """Append a landing's drift to the history on disk; returns the landing's version, from 1.

    A landing without drift is recorded by a row without a column.
    """
    spark = drifted.sparkSession
    schema = "table string, version int, landed_at timestamp, file string, column string, status string"
    try:
        before = spark.read.schema(schema).parquet(history).where(F.col("table") == table).agg(F.max("version")).first()[0]
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        before = None
    version = (before or 0) + 1
    mark = spark.range(1).select(F.lit(None).cast("string").alias("file"), F.lit(None).cast("string").alias("column"),
                                 F.lit("landed").alias("status"))
    rows = drifted.unionByName(mark).select(F.lit(table).alias("table"), F.lit(version).alias("version"),
                                            F.current_timestamp().alias("landed_at"), "file", "column", "status")
    rows.coalesce(1).write.mode("append").parquet(history)
    return version


def _as_text(spark: SparkSession, paths: list[str], columns: list[str]) -> DataFrame:
    """Files of one header as strings; a repeated column keeps its first place.

    Without column pruning, since the number of fields is only checked when all are parsed.
    """
    names = [c if c not in columns[:i] else f"{c}#{i}" for i, c in enumerate(columns)]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, CORRUPT]])
    return (spark.read.option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
            .option("columnPruning", False)
            .schema(schema).csv(paths))


def checked(spark: SparkSession, path: str, schema: T.StructType, found: DataFrame | None = None) -> DataFrame:
    """Rows with the registered columns, ``file``, ``faults`` (column, reason, value) and ``row``.

    ``faults`` is empty for a row that lands. One read per distinct header, of which there are few.
    """
    found = headers(spark, path) if found is None else found
    groups = found.groupBy("columns").agg(F.collect_list("path").alias("paths")).collect()
    out = None
    for columns, paths in groups:
        text = _as_text(spark, paths, columns)
        has = set(columns)

        def cast(field: T.StructField, has=has) -> Column:
            source = F.col(f"`{field.name}`") if field.name in has else F.lit(None)
            return source.try_cast(field.dataType)

        faults = [F.when(F.col(CORRUPT).isNotNull(), F.struct(
            F.lit(None).cast("string").alias("column"), F.lit("other number of fields").alias("reason"), F.col(CORRUPT).alias("value")))]
        for field in schema.fields:
            if field.name in has:
                bad = F.col(f"`{field.name}`").isNotNull() & cast(field).isNull()
                faults.append(F.when(bad, F.struct(F.lit(field.name).alias("column"), F.lit(
                    f"not {field.dataType.simpleString()}").alias("reason"), F.col(f"`{field.name}`").alias("value"))))
        # Of a row with another number of fields none is trusted.
        rows = text.select(*[cast(f).alias(f.name) for f in schema.fields], F.col("_metadata.file_name").alias("file"),
                           F.when(F.col(CORRUPT).isNotNull(), F.array(faults[0])).otherwise(
                               F.filter(F.array(*faults[1:]), lambda x: x.isNotNull())).alias("faults"),
                           F.to_json(F.struct(*[F.col(f"`{c}`") for c in text.columns if c != CORRUPT])).alias("row"))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return spark.createDataFrame([], T.StructType([*schema.fields])).select(
            "*", F.lit(None).cast("string").alias("file"),
            F.lit(None).cast("array<struct<column:string,reason:string,value:string>>").alias("faults"),
            F.lit(None).cast("string").alias("row"))
    return out


def landed(rows: DataFrame, schema: T.StructType) -> DataFrame:
    return rows.where(F.size("faults") == 0).select(*[f.name for f in schema.fields])


def quarantined(rows: DataFrame) -> DataFrame:
    """One row per fault: file, column, reason, value and the whole row."""
    return rows.where(F.size("faults") > 0).select("file", F.inline("faults"), "row")
