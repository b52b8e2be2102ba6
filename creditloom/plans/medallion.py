"""The pipeline from raw CSV to the published gold table.

    python -m creditloom.plans.medallion RAW_DIR OUT_DIR --db gold --table loans

Every step reads the layer before it from disk, so a lost executor only costs
the tasks of the running step.
"""

from __future__ import annotations

import argparse
from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from creditloom.operators import quality
from creditloom.operators.joins import assert_cardinality, fan_in
from creditloom.operators.projection import schema_diff, union_splits
from creditloom.plans import application as a
from creditloom.plans import bureau as b
from creditloom.plans import cleaned, gold as g
from creditloom.plans import previous as p
from creditloom.schemas import RAW_TABLES
from creditloom.session import build_session
from creditloom.sources import manifest, quarantine
from creditloom.sources.checksums import checksums
from creditloom.sources.layers import (
    publish_table, read_layer, read_path, read_raw, replace_path, verify_count, write_layer,
)

HISTORY_TABLES = list(cleaned.KEPT)

#: The files of a complete landing.
LANDED_FILES = (
    "application_train.csv", "application_test.csv", "bureau.csv", "bureau_balance.csv",
    "credit_card_balance.csv", "installments_payments.csv", "POS_CASH_balance.csv",
    "previous_application.csv", "sample_submission.csv", "HomeCredit_columns_description.csv",
)


class LandingError(Exception):
    pass


def verify_landing(spark: SparkSession, raw_dir: str, expected: DataFrame | None = None) -> None:
    """Raise unless the landing holds what it should.

    ``expected`` is the sender's manifest ``(name, length)``, with ``crc32`` where contents are
    to be compared too; without one, the ten known names must be there, none of them empty,
    and nothing else. A file stored as a folder of parts counts as one.
    """
    if expected is None:
        expected = spark.createDataFrame([(n, None) for n in LANDED_FILES], "name string, length long")
    if "crc32" in expected.columns and not expected.where("crc32 IS NOT NULL").isEmpty():
        found = checksums(spark, raw_dir)
    else:
        found = (manifest.list_files(spark, raw_dir)
                 .groupBy(F.substring_index("name", "/", 1).alias("name")).agg(F.sum("length").alias("length")))
    bad = manifest.reconcile_contents(expected, found).where("status != 'ok'").orderBy("name").limit(20).collect()
    if bad:
        raise LandingError("; ".join(f"{r.name}: {r.status}" for r in bad))


def check_schemas(spark: SparkSession, bronze: str) -> None:
    """Raise where a bronze table has lost, gained or retyped a column."""
    for name, schema in RAW_TABLES.items():
        drift = schema_diff(read_layer(spark, bronze, name), schema).where("status != 'ok'").collect()
        if drift:
            raise LandingError("; ".join(f"{name}.{r['column']}: {r.status}" for r in drift))


def land(spark: SparkSession, raw_dir: str, bronze: str, expected: DataFrame | None = None,
         quarantine_dir: str | None = None) -> None:
    """Check the landing, then raw CSV to Parquet once; every later scan is columnar and pruned.

    Headers are compared with the registered schemas first. Without ``quarantine_dir`` any
    drift and any field that does not parse stops the landing. With it, drift is recorded in
    its ``drift`` table and faulty rows go to its ``rows`` table, and the rest lands.
    """
    verify_landing(spark, raw_dir, expected)
    heads = {n: quarantine.headers(spark, f"{raw_dir}/{n}.csv") for n in RAW_TABLES}
    drifts = {n: quarantine.drift(heads[n], schema) for n, schema in RAW_TABLES.items()}
    if quarantine_dir is None:
        found = [f"{n}.{r['column']}: {r.status}" for n, d in drifts.items() for r in d.limit(20).collect()]
        if found:
            raise LandingError("; ".join(found))
    for name, schema in RAW_TABLES.items():
        source = f"{raw_dir}/{name}.csv"
        if quarantine_dir is None:
            write_layer(read_raw(spark, source, schema), f"{bronze}/{name}")
            continue
        version = quarantine.record_drift(name, drifts[name], f"{quarantine_dir}/drift")
        rows = quarantine.checked(spark, source, schema, heads[name])
        # Faulty rows are counted while the others are written; they are read again only where there are some.
        faulty = Observation()
        write_layer(quarantine.landed(rows.observe(faulty, F.count_if(F.size("faults") > 0).alias("n")), schema),
                    f"{bronze}/{name}")
        if faulty.get["n"]:
            bad = quarantine.quarantined(rows).select(F.lit(name).alias("table"), F.lit(version).alias("version"), "*")
            write_layer(bad, f"{quarantine_dir}/rows", mode="append")


def silver_tables(spark: SparkSession, bronze: str, strategy: str = "approx_median",
                  variant: str = "as_coded") -> dict[str, DataFrame]:
    def raw(name: str) -> DataFrame:
        return read_layer(spark, bronze, name)

    return {
        "application_train": a.application_features(raw("application_train"), True, strategy),
        "application_test": a.application_features(raw("application_test"), False, strategy),
        "bureau_features": b.bureau_features(raw("bureau"), raw("bureau_balance"), variant),
        "previous_features": p.previous_features(
            raw("previous_application"), raw("POS_CASH_balance"), raw("installments_payments"),
            raw("credit_card_balance"), variant),
    }


def build_silver(spark: SparkSession, bronze: str, silver: str, strategy: str = "approx_median",
                 variant: str = "as_coded", files: int | None = None) -> None:
    check_schemas(spark, bronze)
    for name, df in silver_tables(spark, bronze, strategy, variant).items():
        write_layer(df, f"{silver}/{name}", files)


def bucket_silver(tables: Mapping[str, DataFrame], db: str, buckets: int, location: str | None = None) -> None:
    """Silver as catalog tables bucketed by loan, the applications of both splits in one.

    All hold one row per loan, so no bucket is larger than others.
    """
    bucketed = {"applications": union_splits(tables["application_train"], tables["application_test"]),
                "bureau_features": tables["bureau_features"], "previous_features": tables["previous_features"]}
    for name, df in bucketed.items():
        publish_table(df, db, name, (buckets, "loanId"), location)


def gold_of_buckets(spark: SparkSession, db: str) -> DataFrame:
    """Gold of bucketed silver: bucket joins bucket, nothing is exchanged."""
    base, *features = (spark.table(f"{db}.{n}") for n in ("applications", "bureau_features", "previous_features"))
    return fan_in(base, features, "loanId")


def gold_suite() -> list[quality.Expectation]:
    return [quality.expect_not_null("loanId"), quality.expect_unique("loanId"),
            quality.expect_in_set("target", [0, 1]), quality.expect_between("ageYears", 18, 100)]


def build_gold(spark: SparkSession, silver: str, db: str, table: str, bucket_by: tuple[int, str] | None = None,
               location: str | None = None) -> DataFrame:
    """Join, write a new version, check it, publish it; returns the row count read back."""
    train, test = (read_layer(spark, silver, f"application_{s}") for s in ("train", "test"))
    result = g.gold(train, test, read_layer(spark, silver, "bureau_features"),
                    read_layer(spark, silver, "previous_features"))
    return publish_gold(spark, result, union_splits(train, test), db, table, bucket_by, location)


def publish_gold(spark: SparkSession, result: DataFrame, base: DataFrame, db: str, table: str,
                 bucket_by: tuple[int, str] | None = None, location: str | None = None) -> DataFrame:
    """Publish gold if what was written passes its suite and has the base's rows and loans."""
    checks = quality.WriteChecks(result, gold_suite())

    def check(written: DataFrame) -> None:
        found = checks.result(written)
        quality.gate(found)
        rows = found.where("expectation = 'unique'").first()
        keys = base.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("loanId").alias("k")).first()
        if (keys.n, keys.k) != (rows.n_rows, rows.n_rows - rows.n_unexpected):
            raise ValueError(f"join changed the cardinality: {keys.asDict()}, then {rows.asDict()}")

    publish_table(checks.measured, db, table, bucket_by, location, check)
    return verify_count(spark, f"{db}.{table}")


def integrated_suite(with_target: bool) -> list[quality.Expectation]:
    suite = [quality.expect_not_null("SK_ID_CURR"), quality.expect_unique("SK_ID_CURR"),
             quality.expect_between("AGE_YEARS", 18, 100)]
    return suite + [quality.expect_in_set("TARGET", [0, 1])] if with_target else suite


def build_integrated(spark: SparkSession, bronze: str, silver: str, final: str,
                     strategy: str = "approx_median", test_strategy: str = "median",
                     files: int | None = None) -> None:
    """Cleaned tables, their features, and the integrated tables of both splits.

    The splits may be imputed differently; by default the test split exactly. The
    final table is written after the staged copy has passed the suite and kept the
    cardinality of the applications.
    """
    check_schemas(spark, bronze)
    for name in HISTORY_TABLES:
        rows = cleaned.clean_table(read_layer(spark, bronze, name), name, mostly_unique=True)
        write_layer(rows, f"{silver}/{name}_clean")
    features = g.features_from_cleaned({n: read_layer(spark, silver, f"{n}_clean")
                                        for n in HISTORY_TABLES})
    stored = []
    for name, df in features.items():
        write_layer(df, f"{silver}/{name}")
        stored.append(read_layer(spark, silver, name))
    for split in ("train", "test"):
        raw = read_layer(spark, bronze, f"application_{split}")
        chosen = strategy if split == "train" else test_strategy
        write_layer(a.application_clean(raw, chosen), f"{silver}/application_{split}_clean")
        base = read_layer(spark, silver, f"application_{split}_clean")
        checks = quality.WriteChecks(g.integrate(base, stored), integrated_suite(split == "train"))
        staging = f"{silver}/{split}_integrated"
        write_layer(checks.measured, staging, files)
        staged = read_path(spark, staging)
        quality.gate(checks.result(staged))
        assert_cardinality(base, staged, "SK_ID_CURR")
        replace_path(spark, staging, f"{final}/{split}")


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    parser.add_argument("raw")
    parser.add_argument("out")
    parser.add_argument("--db", default="gold")
    parser.add_argument("--table", default="loans")
    parser.add_argument("--buckets", type=int, default=0, help="bucket the gold table by loan")
    parser.add_argument("--manifest", help="the sender's CSV of name, length and crc32")
    parser.add_argument("--quarantine", help="folder for faulty rows and schema drift; without it they stop the landing")
    parser.add_argument("--integrated", action="store_true", help="also build the integrated tables")
    parser.add_argument("--shuffle-width", type=int, help="initial partitions of every exchange")
    args = parser.parse_args()
    spark = build_session("creditloom-medallion", shuffle_width=args.shuffle_width)
    bronze, silver = f"{args.out}/bronze", f"{args.out}/silver"
    expected = manifest.read_manifest(spark, args.manifest) if args.manifest else None
    land(spark, args.raw, bronze, expected, args.quarantine)
    build_silver(spark, bronze, silver)
    buckets = (args.buckets, "loanId") if args.buckets else None
    count = build_gold(spark, silver, args.db, args.table, buckets)
    print("gold rows:", count.first().n)
    if args.integrated:
        build_integrated(spark, bronze, silver, f"{args.out}/integrated")


if __name__ == "__main__":
    main()
