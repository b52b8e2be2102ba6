import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditloom.operators import projection, quality
from creditloom.schemas import BUREAU_BALANCE, struct
from creditloom.sources import layers, manifest

SUITE = json.dumps({"expectations": [
    {"expectation_type": "expect_column_values_to_not_be_null", "kwargs": {"column": "SK_ID_CURR"}},
    {"expectation_type": "expect_column_values_to_be_unique", "kwargs": {"column": "SK_ID_CURR"}},
    {"expectation_type": "expect_column_values_to_be_in_set", "kwargs": {"column": "TARGET", "value_set": [0, 1]}},
    {"expectation_type": "expect_column_values_to_be_between",
     "kwargs": {"column": "AGE_YEARS", "min_value": 18, "max_value": 100}}]})
SCHEMA = "SK_ID_CURR int, TARGET int, AGE_YEARS double"
GOOD = [(1, 0, 18.0), (2, 1, 100.0), (3, None, None)]
BAD = [(1, 0, 17.99), (1, 2, 100.01), (None, 1, 50.0)]


def counts(result):
    return {r.expectation: (r.n_unexpected, r.success) for r in result.collect()}


def test_suite_passes_null_in_set_and_between(spark):
    result = quality.validate(spark.createDataFrame(GOOD, SCHEMA), quality.load_suite(SUITE))
    assert counts(result) == {"not_null": (0, True), "unique": (0, True), "in_set": (0, True),
                              "between": (0, True), "suite": (0, True)}
    quality.gate(result)


def test_suite_counts_each_failure(spark):
    df = spark.createDataFrame(BAD, SCHEMA)
    result = quality.validate(df, quality.load_suite(SUITE))
    assert counts(result) == {"not_null": (1, False), "unique": (2, False), "in_set": (1, False),
                              "between": (2, False), "suite": (4, False)}
    with pytest.raises(quality.ValidationError, match=r"unique\(SK_ID_CURR\): 2 of 3"):
        quality.gate(result)
    audit = quality.key_audit(df, "SK_ID_CURR").first()
    assert (audit.n_rows, audit.n_null, audit.n_duplicate) == (3, 1, 1)


def test_promote_writes_only_validated_data(spark, tmp_path):
    suite = quality.load_suite(SUITE)
    bad, good = f"{tmp_path}/bad", f"{tmp_path}/good"
    with pytest.raises(quality.ValidationError):
        quality.promote(spark.createDataFrame(BAD, SCHEMA), suite, bad, f"{tmp_path}/s1")
    assert not os.path.exists(bad)
    assert quality.promote(spark.createDataFrame(GOOD, SCHEMA), suite, good, f"{tmp_path}/s2", 1).count() == 3


def test_checks_taken_while_writing_equal_those_taken_after(spark, tmp_path, rows):
    suite = quality.load_suite(SUITE)
    for i, data in enumerate((BAD, GOOD, [])):
        df = spark.createDataFrame(data, SCHEMA)
        checks = quality.WriteChecks(df, suite)
        layers.write_layer(checks.measured, f"{tmp_path}/w{i}")
        assert rows(checks.result(layers.read_path(spark, f"{tmp_path}/w{i}"))) == rows(quality.validate(df, suite))
        plan = checks.result(layers.read_path(spark, f"{tmp_path}/w{i}"))._jdf.queryExecution().executedPlan().toString()
        assert "ReadSchema: struct<SK_ID_CURR:" in plan and "AGE_YEARS" not in plan.split("ReadSchema")[1]


def test_a_write_that_dies_leaves_the_old_version(spark, tmp_path):
    old, worse = spark.range(10), spark.range(100).select(F.when(F.col("id") < 97, F.col("id")).otherwise(
        F.raise_error(F.lit("killed"))).alias("id")).repartition(5)
    db = "version_test"
    try:
        layers.publish_table(old, db, "T", location=f"{tmp_path}/db")
        with pytest.raises(Exception, match="killed"):
            layers.publish_table(worse, db, "T")
        assert spark.table(f"{db}.T").count() == 10

        def refuse(written):
            assert written.count() == 3
            raise quality.ValidationError("refused")

        with pytest.raises(quality.ValidationError):
            layers.publish_table(spark.range(3), db, "T", check=refuse)
        assert spark.table(f"{db}.T").count() == 10 and len(layers.versions(spark, db, "T")) == 1
        for n in (11, 12, 13):
            layers.publish_table(spark.range(n).withColumn("more", F.lit(n)), db, "T", keep=2)
        assert spark.table(f"{db}.T").count() == 13 and spark.table(f"{db}.T").columns == ["id", "more"]
        assert [n.split("_")[2] for n in layers.versions(spark, db, "T")] == ["v000003", "v000004"]
    finally:
        spark.sql(f"DROP DATABASE {db} CASCADE")


def test_replace_path_is_repeatable(spark, tmp_path):
    for n in (1, 2):
        layers.write_layer(spark.range(n), f"{tmp_path}/new")
        layers.replace_path(spark, f"{tmp_path}/new", f"{tmp_path}/deep/final")
        assert layers.read_path(spark, f"{tmp_path}/deep/final").count() == n
    os.rename(f"{tmp_path}/deep/final", f"{tmp_path}/deep/final.replaced")     # killed between the two renames
    layers.write_layer(spark.range(5), f"{tmp_path}/new")
    layers.replace_path(spark, f"{tmp_path}/new", f"{tmp_path}/deep/final")
    assert layers.read_path(spark, f"{tmp_path}/deep/final").count() == 5
    assert sorted(os.listdir(f"{tmp_path}/deep")) == ["final"]
    with pytest.raises(OSError):
        layers.replace_path(spark, f"{tmp_path}/none", f"{tmp_path}/deep/other")


def test_csv_needs_a_matching_header(spark, tmp_path, rows):
    path = tmp_path / "b.csv"
    path.write_text("SK_ID_BUREAU,MONTHS_BALANCE,STATUS\n1,-1,C\n2,0,\n")
    df = layers.read_raw(spark, str(path), BUREAU_BALANCE)
    assert df.schema == BUREAU_BALANCE and rows(df) == [(1, -1, "C"), (2, 0, None)]
    assert dict(layers.read_raw(spark, str(path), infer=True).dtypes)["MONTHS_BALANCE"] == "int"
    path.write_text("MONTHS_BALANCE,SK_ID_BUREAU,STATUS\n-1,1,C\n")
    with pytest.raises(Exception, match="(?i)header"):
        layers.read_raw(spark, str(path), BUREAU_BALANCE).collect()


def test_layers_publish_and_export(spark, tmp_path, rows):
    df = spark.range(100).selectExpr("id AS k", "id % 3 AS v")
    layers.write_layer(df, f"{tmp_path}/silver/t", files=3)
    assert len([f for f in os.listdir(f"{tmp_path}/silver/t") if f.endswith(".parquet")]) == 3
    layers.write_layer(df, f"{tmp_path}/silver/t2", rebalance=True)
    assert rows(layers.read_layer(spark, f"{tmp_path}/silver", "t2")) == rows(df)
    back = layers.read_layer(spark, f"{tmp_path}/silver", "t")
    layers.publish_table(back, "layer_test", "t", bucket_by=(4, "k"))
    layers.publish_table(back, "layer_test", "t", bucket_by=(4, "k"))       # overwrite
    assert layers.verify_count(spark, "layer_test.t").first().n == 100
    assert len([f for f in spark.table("layer_test.t").inputFiles()]) <= 4
    joined = spark.table("layer_test.t").hint("merge").join(spark.table("layer_test.t"), "k")
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    layers.export_csv(back, f"{tmp_path}/csv")
    again = layers.read_raw(spark, f"{tmp_path}/csv", struct(long="k v"))
    assert rows(again) == rows(df)
    spark.sql("DROP DATABASE layer_test CASCADE")


def test_views_and_sql(spark, rows):
    df = spark.range(3)
    layers.register(spark, {"three": df})
    assert layers.query(spark, "SELECT count(*) AS n FROM three").first().n == 3
    assert layers.query(spark, "SELECT max(id) AS n FROM {t}", t=df).first().n == 2


def test_schema_repair_and_diff(spark, rows):
    wanted = T.StructType([T.StructField("AMT_CREDIT", T.DoubleType()),
                           T.StructField("NAME_CONTRACT_TYPE", T.StringType()),
                           T.StructField("N", T.IntegerType())])
    df = spark.createDataFrame([(1.0, "x", 1)], "AMT_CREDIT double, NEW_FEATURE_COL string, N string")
    assert rows(projection.schema_diff(df, wanted)) == [
        ("AMT_CREDIT", "double", "double", "ok"), ("N", "int", "string", "type_changed"),
        ("NAME_CONTRACT_TYPE", "string", None, "missing"), ("NEW_FEATURE_COL", None, "string", "added")]
    fixed = projection.align_schema(df, wanted)
    assert fixed.schema == wanted and rows(fixed) == [(1.0, None, 1)]


def test_reconcile_statuses(spark, rows):
    side = "name string, length long"
    expected = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], side)
    landed = spark.createDataFrame([("a", 1), ("b", 5), ("d", 4)], side)
    result = manifest.reconcile_manifest(expected, landed)
    assert [(r[0], r[3]) for r in rows(result)] == [
        ("a", "ok"), ("b", "size_mismatch"), ("c", "missing"), ("d", "extra")]
    verdict = manifest.landing_verdict(result).first()
    assert (verdict.n_expected, verdict.n_landed, verdict.n_bad, verdict.success) == (3, 3, 3, False)


def test_listing_and_fingerprint_of_landed_files(spark, tmp_path, rows):
    for folder, order in (("src", (1, 2)), ("dst", (2, 1))):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "t.csv").write_text("".join(f"row {i}\n" for i in order))
    source, landed = (manifest.list_files(spark, f"{tmp_path}/{d}") for d in ("src", "dst"))
    assert rows(source) == [("t.csv", 12)]
    (tmp_path / "src" / "deep").mkdir()
    (tmp_path / "src" / "deep" / "t.csv").write_text("row 9\n")
    assert rows(manifest.list_files(spark, f"file://{tmp_path}/src/")) == [("deep/t.csv", 6), ("t.csv", 12)]
    assert [r[0] for r in rows(manifest.content_fingerprint(spark, f"{tmp_path}/src"))] == ["deep/t.csv", "t.csv"]
    (tmp_path / "src" / "deep" / "t.csv").unlink()
    assert manifest.landing_verdict(manifest.reconcile_manifest(source, landed)).first().success
    prints = [manifest.content_fingerprint(spark, f"{tmp_path}/{d}") for d in ("src", "dst")]
    assert rows(prints[0]) == rows(prints[1])
    checked = manifest.reconcile_manifest(*prints, measure="checksum")
    assert [r.status for r in checked.collect()] == ["ok"]
    (tmp_path / "dst" / "t.csv").write_text("row 1\nrow 3\n")
    changed = manifest.content_fingerprint(spark, f"{tmp_path}/dst")
    assert manifest.reconcile_manifest(prints[0], changed, "checksum").first().status == "size_mismatch"
