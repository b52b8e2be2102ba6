import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from creditloom.operators import cleaning, sketches
from creditloom.sources import layers


def test_merged_sketches_keep_the_rank_error(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=20_000), rng.exponential(size=9_000) + 3])
    df = spark.createDataFrame(pd.DataFrame({"day": np.arange(len(x)) % 7, "x": x})).withColumn("none", F.lit(None).cast("double"))
    daily = sketches.fit_sketches(df.repartition(9), ["x", "none"], 0.01, by=["day"])
    whole = sketches.sketch_quantiles(sketches.merge_sketches(daily))
    assert [r["column"] for r in whole.collect()] == ["x"]
    assert abs((x < whole.first().fill).mean() - 0.5) < 0.01
    per_day = sketches.sketch_quantiles(sketches.merge_sketches(daily.unionByName(daily), by=["day"]), 0.9, "q").collect()
    assert sorted(r.day for r in per_day) == list(range(7))
    assert all(abs((x[r.day::7] <= r.q).mean() - 0.9) < 0.015 for r in per_day)


@pytest.mark.parametrize("tracked,candidates", [(10_000, 32), (8, 3)])
def test_mode_of_many_values(spark, rows, tracked, candidates):
    n = 6000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("v"), "id")).alias("third"),
        F.col("id").cast("string").alias("unique"),
        F.when(F.col("id") % 5 < 2, None).otherwise(F.concat(F.lit("w"), F.col("id") % 40)).alias("mostly_null"),
        F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("tie"), F.lit(None).cast("string").alias("none"))
    want = rows(cleaning.fit_mode(df, df.columns))
    assert rows(sketches.fit_mode_of_many(df.repartition(7), df.columns, tracked=tracked, candidates=candidates)) == want
    assert sketches.fit_mode_of_many(df.where("false"), df.columns).count() == cleaning.fit_mode(df.where("false"), df.columns).count()


def test_distinct_moves_only_repeated_rows(spark, rows):
    unique = spark.range(20_000).selectExpr("id AS f0", "CAST(id AS STRING) AS s", "IF(id % 2 = 0, NULL, id) AS x")
    mixed = unique.union(unique.where("f0 < 100")).union(unique.where("f0 < 100 AND f0 % 2 = 0"))
    swapped = spark.createDataFrame([(None, "1"), ("1", None), (None, "1"), ("", "1"), (None, None)], "a string, b string")
    for df in (unique, mixed, swapped, unique.where("false")):
        assert rows(sketches.distinct_of_mostly_unique(df)) == rows(df.distinct())
        assert sketches.distinct_of_mostly_unique(df).schema == df.schema
    assert rows(sketches.distinct_of_mostly_unique(mixed, most=5)) == rows(unique)
    plan = sketches.distinct_of_mostly_unique(unique)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    plan = sketches.distinct_of_mostly_unique(mixed)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "BroadcastHashJoin" in plan


def test_distinct_by_columns_that_rarely_repeat(spark, rows):
    unique = spark.range(20_000).selectExpr("id", "id % 3 AS x", "CAST(id AS STRING) AS s")
    odd = unique.where("id < 50").unionByName(unique.where("id < 30")).unionByName(
        unique.where("id < 20").withColumn("x", F.lit(None).cast("long"))).unionByName(
        unique.where("id < 10").withColumn("id", F.lit(None).cast("long"))).unionByName(
        unique.where("id < 10").withColumn("id", F.lit(None).cast("long")))
    for df in (unique, odd, unique.where("false")):
        found = sketches.distinct_of_mostly_unique(df, by=["id"])
        assert rows(found) == rows(df.distinct()) and found.schema == df.schema
    assert rows(sketches.distinct_of_mostly_unique(odd, most=5, by=["id"])) == rows(odd.distinct())


def test_count_from_footers(spark, tmp_path):
    layers.write_layer(spark.range(1000), f"{tmp_path}/t", files=3)
    before = spark.conf.get("spark.sql.sources.useV1SourceList")
    counted = layers.footer_count(spark, f"{tmp_path}/t")
    assert counted.first().n == 1000 and spark.conf.get("spark.sql.sources.useV1SourceList") == before
    assert "PushedAggregation: [COUNT(*)]" in counted._jdf.queryExecution().executedPlan().toString()
