import pytest
from pyspark.sql import functions as F

from creditloom.operators import joins
from creditloom.operators.features import FeatureSpec


def test_join_detail_equals_left_join_with_a_hot_key(spark, rows):
    parent = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d"), (None, "e")], "k int, p string")
    child = spark.range(300).select(F.when(F.col("id") < 200, 1).otherwise(2).alias("k"),
                                    F.col("id").alias("c"))
    child = child.unionByName(spark.createDataFrame([(None, 1), (9, 2)], "k int, c long"))
    assert rows(joins.join_detail(parent, child, "k")) == rows(parent.join(child, "k", "left"))


def test_join_summary_keeps_one_row_per_parent_row(spark, rows):
    parent = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    child = spark.createDataFrame([(1, 5), (1, 6)], "k int, v int")
    got = joins.join_summary(parent, child, "k", [F.sum("v").alias("s")])
    assert rows(got) == [(1, 11), (1, 11), (2, None)]


def test_keyless_parents_go_around_the_join(spark, rows):
    parent = spark.createDataFrame([(1, "a"), (None, "b"), (None, "c")], "k int, p string")
    child = spark.createDataFrame([(1, 5), (None, 6)], "k int, v int")
    want = rows(parent.join(child.groupBy("k").agg(F.sum("v").alias("s")), "k", "left"))
    assert rows(joins.join_summary(parent, child, "k", [F.sum("v").alias("s")])) == want


def test_hot_child_key_is_split(spark):
    """The detail join lets adaptive execution split a key with a third of all rows."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200KB",
                "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        parent = spark.range(100_000).selectExpr("id AS k", "id AS p")
        child = spark.range(600_000).selectExpr("IF(id % 3 = 0, 5L, id % 100000) AS k",
                                                "shiftright(xxhash64(id), 24) AS v")
        total = joins.join_detail(parent, child, "k").agg(F.count("v"), F.max("v"), F.max("p"))
        assert total.collect()[0][0] == 600_000
        assert "SortMergeJoin(skew=true)" in total._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def spec(name):
    return FeatureSpec(name, {f"{name}_n": F.count(F.lit(1))},
                       {f"{name}_n": F.col(f"{name}_n"), f"{name}_many": F.col(f"{name}_n") > 1})


def test_union_merge_equals_full_outer_join(spark, rows):
    details = {"a": [(1,), (1,), (2,), (None,)], "b": [(2,), (3,), (3,)], "c": [(None,), (3,), (4,)]}
    parts = [(spec(n), spark.createDataFrame(d, "loanId int")) for n, d in details.items()]
    merged = joins.union_merge(parts, "loanId")
    chained = joins.full_outer_merge([s.table(d) for s, d in parts], "loanId")
    assert merged.columns == chained.columns
    assert rows(merged) == rows(chained)
    assert merged.where("loanId IS NULL").count() == 2, "NULL keys of different parts stay apart"


def test_fan_in_keeps_rows_and_nulls(spark, rows):
    base = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    f = spark.createDataFrame([(1, 10), (3, 30)], "k int, x int")
    g = spark.createDataFrame([(2, 20)], "k int, y int")
    assert rows(joins.fan_in(base, [f, g], "k")) == [(None, None, None), (1, 10, None), (2, None, 20)]


def test_cardinality(spark, one):
    base = spark.createDataFrame([(1,), (2,)], "k int")
    double = spark.createDataFrame([(1, 1), (1, 2)], "k int, x int")
    single = double.where("x = 1")
    joins.assert_cardinality(base, joins.fan_in(base, [single], "k"), "k")
    with pytest.raises(ValueError, match="cardinality"):
        joins.assert_cardinality(base, joins.fan_in(base, [double], "k"), "k")
    assert one(joins.cardinality_check(base, base, "k"))["preserved"] is True
