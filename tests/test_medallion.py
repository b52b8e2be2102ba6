"""CSV to published gold, end to end, on derived raw files."""

import os

import pytest
from pyspark.sql import functions as F

from creditloom.plans import medallion
from creditloom.schemas import RAW_TABLES
from creditloom.sources.layers import export_csv, read_layer
from workload import roles

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture
def raw_dir(spark, tmp_path):
    sources = roles.raw(spark, SF) | {"application_train": roles.application_train(spark, SF),
                                      "application_test": roles.application_test(spark, SF)}
    for name, df in sources.items():
        schema = RAW_TABLES[name]
        full = df.select([F.col(f.name).cast(f.dataType) if f.name in df.columns
                          else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])
        export_csv(full, f"{tmp_path}/raw/{name}.csv")
    for name in set(medallion.LANDED_FILES) - {f"{n}.csv" for n in RAW_TABLES}:
        (tmp_path / "raw" / name).write_text("a,b\n1,2\n")
    return f"{tmp_path}/raw"


def test_faulty_landings_and_joins_stop_the_pipeline(spark, raw_dir, tmp_path):
    import shutil

    bronze, silver = f"{tmp_path}/bronze", f"{tmp_path}/silver"
    lost = tmp_path / "raw" / "sample_submission.csv"
    lost.unlink()
    with pytest.raises(medallion.LandingError, match="sample_submission.csv: missing"):
        medallion.land(spark, raw_dir, bronze)
    lost.write_text("a\n")
    sizes = spark.createDataFrame([(n, 1) for n in medallion.LANDED_FILES], "name string, length long")
    with pytest.raises(medallion.LandingError, match="size_mismatch"):
        medallion.land(spark, raw_dir, bronze, sizes)
    good = f"{tmp_path}/good"
    shutil.copytree(f"{raw_dir}/bureau_balance.csv", good)
    bad = tmp_path / "raw" / "bureau_balance.csv" / "part-bad.csv"
    bad.write_text("SK_ID_BUREAU,MONTHS_BALANCE,STATUS\n1,twelve,C\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        medallion.land(spark, raw_dir, bronze)
    bad.unlink()
    medallion.land(spark, raw_dir, bronze)
    shutil.rmtree(f"{bronze}/bureau")
    read_layer(spark, bronze, "bureau_balance").write.parquet(f"{bronze}/bureau")
    with pytest.raises(medallion.LandingError, match="bureau.CREDIT_ACTIVE: missing"):
        medallion.build_silver(spark, bronze, silver)
    medallion.land(spark, raw_dir, bronze)
    medallion.build_silver(spark, bronze, silver)
    features = read_layer(spark, silver, "bureau_features")
    features.union(features.limit(1)).write.parquet(f"{tmp_path}/twice")
    shutil.rmtree(f"{silver}/bureau_features")
    shutil.copytree(f"{tmp_path}/twice", f"{silver}/bureau_features")
    with pytest.raises(Exception, match="unique|cardinality"):
        medallion.build_gold(spark, silver, "medallion_bad", "loans")
    assert [t.name for t in spark.catalog.listTables("medallion_bad") if not t.isTemporary] == []
    spark.sql("DROP DATABASE medallion_bad")


def test_manifest_finds_cut_reordered_and_empty_files(spark, raw_dir, tmp_path):
    from creditloom.sources.checksums import checksums
    from creditloom.sources.manifest import read_manifest

    checksums(spark, raw_dir).coalesce(1).write.option("header", True).csv(f"{tmp_path}/manifest.csv")
    sent = read_manifest(spark, f"{tmp_path}/manifest.csv")
    medallion.verify_landing(spark, raw_dir, sent)
    part = sorted((tmp_path / "raw" / "bureau.csv").glob("part-*"))[0]
    (part.parent / f".{part.name}.crc").unlink()     # the local file system's own check
    text = part.read_bytes()
    head, *lines = text.splitlines(keepends=True)
    for changed, status in ((text[:-40], "size_mismatch"), (head + b"".join(reversed(lines)), "checksum_mismatch")):
        part.write_bytes(changed)
        with pytest.raises(medallion.LandingError, match=f"bureau.csv: {status}"):
            medallion.verify_landing(spark, raw_dir, sent)
    part.write_bytes(text)
    small = tmp_path / "raw" / "sample_submission.csv"
    small.write_text("")
    with pytest.raises(medallion.LandingError, match="sample_submission.csv: empty"):
        medallion.verify_landing(spark, raw_dir)


def test_widened_and_faulty_files_are_quarantined(spark, raw_dir, tmp_path):
    bronze, aside = f"{tmp_path}/bronze", f"{tmp_path}/aside"
    folder = tmp_path / "raw" / "bureau_balance.csv"
    medallion.land(spark, raw_dir, bronze, None, aside)
    before = read_layer(spark, bronze, "bureau_balance").count()
    assert not os.path.exists(f"{aside}/rows")
    (folder / "part-wide.csv").write_text("SK_ID_BUREAU,STATUS,NEW_COL\n1,C,x\n2,0,y\n")
    (folder / "part-bad.csv").write_text("SK_ID_BUREAU,MONTHS_BALANCE,STATUS\n1,twelve,C\n2,-1,X\n3,-1\n")
    with pytest.raises(medallion.LandingError, match="bureau_balance.NEW_COL: added"):
        medallion.land(spark, raw_dir, bronze)
    medallion.land(spark, raw_dir, bronze, None, aside)
    assert read_layer(spark, bronze, "bureau_balance").count() == before + 3
    found = spark.read.parquet(f"{aside}/rows").orderBy("reason").collect()
    assert [(r.table, r.version, r.file, r["column"], r.reason, r.value) for r in found] == [
        ("bureau_balance", 2, "part-bad.csv", "MONTHS_BALANCE", "not int", "twelve"),
        ("bureau_balance", 2, "part-bad.csv", None, "other number of fields", "3,-1")]
    drift = spark.read.parquet(f"{aside}/drift").where("column IS NOT NULL").orderBy("column").collect()
    assert [(r.version, r.file, r["column"], r.status) for r in drift] == [
        (2, "part-wide.csv", "MONTHS_BALANCE", "missing"), (2, "part-wide.csv", "NEW_COL", "added")]


def test_pipeline(spark, raw_dir, tmp_path):
    bronze, silver = f"{tmp_path}/bronze", f"{tmp_path}/silver"
    medallion.land(spark, raw_dir, bronze)
    assert set(os.listdir(bronze)) == set(RAW_TABLES)
    medallion.build_silver(spark, bronze, silver)
    count = medallion.build_gold(spark, silver, "medallion_test", "loans", bucket_by=(4, "loanId"))
    customers = roles.table(spark, SF, "customer").count()
    assert count.first().n == customers
    gold = spark.table("medallion_test.loans")
    assert len(gold.columns) == 65
    assert gold.where("target IS NULL").count() == roles.application_test(spark, SF).count()
    spark.sql("DROP DATABASE medallion_test CASCADE")
    medallion.bucket_silver(medallion.silver_tables(spark, bronze), "silver_test", 4)
    joined = medallion.gold_of_buckets(spark, "silver_test")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 2 and "Exchange" not in plan
        assert joined.count() == customers and joined.columns == gold.columns
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("DROP DATABASE silver_test CASCADE")


def test_integrated_tables(spark, raw_dir, tmp_path):
    bronze, silver, final = (f"{tmp_path}/{n}" for n in ("bronze", "silver", "final"))
    medallion.land(spark, raw_dir, bronze)
    medallion.build_integrated(spark, bronze, silver, final, files=2)
    train, test = read_layer(spark, final, "train"), read_layer(spark, final, "test")
    assert train.count() + test.count() == roles.table(spark, SF, "customer").count()
    assert set(train.columns) - set(test.columns) == {"TARGET"}
    assert len(train.columns) == 123 + 53                 # 122 raw columns, one more for the indicator
