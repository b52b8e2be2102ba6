"""Reconciling landed raw files with what was meant to be landed."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"


def relative_name(root: str, path: Column) -> Column:
    """Path relative to the landing root, so that files of one base name stay apart."""
    folder = re.sub(_AUTHORITY, "", root).rstrip("/")
    plain = F.regexp_replace(path, _AUTHORITY, "")
    return F.substr(plain, F.lit(len(folder) + 2))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """``(name, length)`` of every file below ``path``; contents are not read.

    Names are relative to ``path``, which is a plain folder. Empty files are never read by
    Spark's sources; their names come from the listing that the source has made already.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    listed = spark.createDataFrame([(unquote(f),) for f in files.inputFiles()], "path string")
    found = files.select(relative_name(path, F.col("path")).alias("name"), "length")
    return (listed.select(relative_name(path, F.col("path")).alias("name")).join(found, "name", "left")
            .fillna(0, ["length"]))


def content_fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """``(name, n_lines, checksum)`` per text file, whatever its size.

    Files are split over tasks; a per-line hash is summed exactly, so the
    checksum does not depend on the split or on line order.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(path)
    return (lines.select(relative_name(path, F.col("_metadata.file_path")).alias("name"), "value")
            .groupBy("name")
            .agg(F.count(F.lit(1)).alias("n_lines"),
                 F.sum(F.xxhash64("value").cast("decimal(38,0)")).alias("checksum")))


def reconcile_manifest(expected: DataFrame, landed: DataFrame, measure: str = "length") -> DataFrame:
    """Status of each file: ``ok``, ``missing``, ``extra`` or ``size_mismatch``.

    Both sides are ``(name, <measure>)``. A name listed more than once counts
    with the sum of its measures.
    """
    def side(df: DataFrame, label: str) -> DataFrame:
        return df.groupBy("name").agg(F.sum(measure).alias(label))

    both = side(expected, "expected").join(side(landed, "landed"), "name", "full")
    status = (F.when(F.col("landed").isNull(), "missing")
              .when(F.col("expected").isNull(), "extra")
              .when(F.col("expected") != F.col("landed"), "size_mismatch")
              .otherwise("ok"))
    return both.withColumn("status", status)


def reconcile_contents(expected: DataFrame, landed: DataFrame) -> DataFrame:
    """Status of each file by name, length and, where both sides know it, CRC-32.

    ``ok``, ``missing``, ``extra``, ``empty``, ``size_mismatch`` or ``checksum_mismatch``. A NULL
    length or checksum is unknown and not compared; a landed file of length 0 is never right.
    """
    def side(df: DataFrame, prefix: str) -> DataFrame:
        crc = F.col("crc32") if "crc32" in df.columns else F.lit(None)
        return df.select("name", F.col("length").cast("long").alias(f"{prefix}_length"),
                         crc.cast("long").alias(f"{prefix}_crc32"), F.lit(True).alias(prefix))

    both = side(expected, "expected").join(side(landed, "landed"), "name", "full")
    status = (F.when(F.col("landed").isNull(), "missing")
              .when(F.col("expected").isNull(), "extra")
              .when(F.col("landed_length") == 0, "empty")
              .when(F.col("expected_length") != F.col("landed_length"), "size_mismatch")
              .when(F.col("expected_crc32") != F.col("landed_crc32"), "checksum_mismatch")
              .when(F.col("expected_crc32").isNotNull() & F.col("landed_crc32").isNull(), "checksum_mismatch")
              .otherwise("ok"))
    return both.withColumn("status", status)


MANIFEST = "name string, length long, crc32 long"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The sender's manifest: CSV with a header, name, length and, where it has one, crc32."""
    named = spark.read.option("header", True).csv(path)
    known = [c if c in named.columns else "NULL" for c in ("name", "length", "crc32")]
    return named.selectExpr(*(f"CAST({c} AS {kind.split()[1]}) AS {kind.split()[0]}"
                              for c, kind in zip(known, MANIFEST.split(", "))))


def landing_verdict(reconciled: DataFrame) -> DataFrame:
    """File counts and one overall flag."""
    return reconciled.agg(
        F.count("expected").alias("n_expected"), F.count("landed").alias("n_landed"),
        F.count_if(F.col("status") != "ok").alias("n_bad"),
    ).withColumn("success", F.col("n_bad") == 0)
