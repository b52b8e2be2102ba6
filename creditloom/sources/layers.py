"""Reading and writing the bronze, silver and gold layers."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_raw(spark: SparkSession, path: str, schema: T.StructType | None = None,
             infer: bool = False) -> DataFrame:
    """CSV with a header.

    Give a schema: inference reads the whole file once more before any query.
    Columns are matched by position under a schema, so the header is checked. A
    field that does not parse fails the read; as NULL it would be imputed later.
    """
    reader = spark.read.option("header", True)
    if schema is not None:
        return reader.schema(schema).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)
    return reader.option("inferSchema", infer).csv(path)


def read_path(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_layer(spark: SparkSession, layer: str, name: str) -> DataFrame:
    return read_path(spark, f"{layer.rstrip('/')}/{name}")


def write_layer(df: DataFrame, path: str, files: int | None = None, mode: str = "overwrite",
                rebalance: bool = False) -> None:
    """Parquet, one file per task by default.

    ``files`` bounds the file count with an exchange, not ``coalesce``: that
    would run the whole upstream stage in so few tasks. ``rebalance`` lets
    adaptive execution size the files instead, also where partitions are skewed.
    """
    out = df
    if files is not None:
        out = df.repartition(files)
    elif rebalance:
        out = df.hint("rebalance")
    out.write.mode(mode).parquet(path)


def stage_write(df: DataFrame, tmp_path: str) -> DataFrame:
    """Write next to the input, never over it, and read the copy back."""
    write_layer(df, tmp_path)
    return read_path(df.sparkSession, tmp_path)


def replace_path(spark: SparkSession, staged: str, path: str) -> None:
    """Put a written folder in the place of another one on the same file system, by renaming.

    The old folder is out of the way before the new one takes its name and is deleted last: a
    process killed in between leaves both, whole, and the next call puts things right.
    """
    jvm = spark.sparkContext._jvm
    new, final, old = (jvm.org.apache.hadoop.fs.Path(p.rstrip("/")) for p in (staged, path, path.rstrip("/") + ".replaced"))
    fs = final.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(new):
        raise OSError(f"there is nothing at {staged}")
    if fs.exists(final):
        fs.delete(old, True)
        fs.rename(final, old)
    fs.mkdirs(final.getParent())
    if not fs.rename(new, final):
        raise OSError(f"{staged} could not be moved to {path}")
    fs.delete(old, True)


def versions(spark: SparkSession, db: str, table: str) -> list[str]:
    """Names of the stored versions of a published table, oldest first."""
    return sorted(r.tableName for r in spark.sql(f"SHOW TABLES IN {db} LIKE '{table.lower()}__v*'").collect())


def publish_table(df: DataFrame, db: str, table: str, bucket_by: tuple[int, str] | None = None,
                  location: str | None = None, check: Callable[[DataFrame], None] | None = None,
                  keep: int = 2) -> None:
    """Publish a new version of a catalog table; bucketing by the key spares later joins a shuffle.

    The rows are written to a table of their own, ``check`` may refuse what was written, and only
    then the published name, a view, is pointed at it in one catalog change. Until that moment
    readers see the old version, also when the write dies half-way; the last ``keep`` versions
    stay for readers that have begun. Bucket by a key with few rows each: every bucket is
    written by one task, as one file. ``location`` is where a new database keeps its tables.
    """
    spark = df.sparkSession
    where = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {db}{where}")
    before = versions(spark, db, table)
    number = 1 + (int(before[-1].rsplit("__v", 1)[1].split("_")[0]) if before else 0)
    version = f"{table.lower()}__v{number:06d}_{uuid.uuid4().hex[:8]}"
    if bucket_by is None:
        writer = df.write
    else:
        n, key = bucket_by
        writer = df.repartition(n, key).write.bucketBy(n, key).sortBy(key)
    writer.format("parquet").mode("errorifexists").saveAsTable(f"{db}.{version}")
    if check is not None:
        try:
            check(spark.table(f"{db}.{version}"))
        except Exception:
            spark.sql(f"DROP TABLE {db}.{version}")
            raise
    spark.sql(f"CREATE OR REPLACE VIEW {db}.{table} AS SELECT * FROM {db}.{version}")
    for old in [*before, version][:-keep]:
        spark.sql(f"DROP TABLE {db}.{old}")


def export_csv(df: DataFrame, path: str) -> None:
    """CSV part files with a header, written by the executors."""
    df.write.mode("overwrite").option("header", True).csv(path)


def verify_count(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table).agg(F.count(F.lit(1)).alias("n"))


def footer_count(spark: SparkSession, path: str) -> DataFrame:
    """Number of rows of a Parquet folder, from the footers of its files.

    The source's second version pushes the count down; no page is read. It is chosen while the
    path is resolved and the session's choice is put back.
    """
    key, before = "spark.sql.sources.useV1SourceList", spark.conf.get("spark.sql.sources.useV1SourceList")
    spark.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    spark.conf.set(key, ",".join(s for s in before.split(",") if s != "parquet"))
    try:
        return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"))
    finally:
        spark.conf.set(key, before)


def register(spark: SparkSession, views: Mapping[str, DataFrame]) -> None:
    for name, df in views.items():
        df.createOrReplaceTempView(name)


def query(spark: SparkSession, text: str, **views: DataFrame) -> DataFrame:
    """SQL over frames named in the text as ``{name}``; no session-wide view names."""
    return spark.sql(text, **views)
