import pytest
from pyspark.sql import functions as F

from creditloom import functions as f
from creditloom.operators import projection
from creditloom.plans import application as a


def values(spark, column, data, schema):
    df = spark.createDataFrame(data, schema)
    return [r[0] for r in df.select(column).collect()]


def test_ratio_zero_and_null_denominators(spark):
    data, schema = [(6.0, 3.0), (6.0, 0.0), (6.0, None), (None, 2.0)], "n double, d double"
    assert values(spark, f.ratio("n", "d"), data, schema) == [2.0, 0.0, None, None]
    assert values(spark, f.ratio("n", "d", None), data, schema) == [2.0, None, None, None]


def test_flags_treat_unknown_as_zero(spark):
    data, schema = [(1,), (5,), (None,)], "x int"
    assert values(spark, f.flag(F.col("x") > 2), data, schema) == [0, 1, 0]
    assert values(spark, f.between_flag("x", 1, 5), data, schema) == [1, 1, 0]


def test_days_to_years_variants(spark):
    data, schema = [(-12784,), (-365243,), (None,)], "d int"      # 12784 / 365.25 = 35.0007
    assert values(spark, f.days_to_years("d"), data, schema) == [35, 1000, None]
    assert values(spark, f.days_to_years("d", digits=2), data, schema) == [35.0, 999.98, None]
    assert values(spark, f.days_to_years("d", mode="floor"), data, schema) == [35, 999, None]
    half = [(-(365 * 2 + 183),)]                                   # 2.4997 years
    assert values(spark, f.days_to_years("d"), half, schema) == [2]
    with pytest.raises(ValueError):
        f.days_to_years("d", mode="ceil")


def test_code_to_int_ignores_letters(spark):
    data, schema = [("C",), ("X",), ("0",), ("5",), ("9",), (None,)], "s string"
    codes = ["1", "2", "3", "4", "5"]
    assert values(spark, f.code_to_int("s", codes), data, schema) == [0, 0, 0, 5, 0, 0]
    assert values(spark, f.code_to_int("s"), data, schema) == [None, None, 0, 5, 9, None]


def test_groups_profiles_and_scores(spark):
    data = [("Drivers",), ("None",), ("Managers",), (None,)]
    assert values(spark, a.occupation_risk("o"), data, "o string") == [
        "High Risk", "Medium Risk", "Low Risk", "Low Risk"]
    pairs = [(0, 0), (0, 1), (1, 1), (1, 0), (None, 1)]
    assert values(spark, f.cross_profile("x", "y", a.COMMUTE_LABELS, a.COMMUTE_DEFAULT), pairs,
                  "x int, y int") == ["Stabil", "Komuter Lokal", "Komuter Jauh", "Lainnya", "Lainnya"]
    score = f.score_conditions(F.col("x") == 1, F.col("y") == 1)
    assert values(spark, score, pairs, "x int, y int") == [0, 1, 2, 1, 1]
    assert values(spark, f.sum_flags(["x", "y"]), pairs, "x int, y int") == [0, 1, 2, 1, None]


def test_bucketize_first_match_wins(spark):
    col = f.bucketize([(F.col("x") >= 1, "a"), (F.col("x") >= 0, "b")], "rest")
    assert values(spark, col, [(1,), (0,), (-1,), (None,)], "x int") == ["a", "b", "rest", "rest"]


def test_like_coalesce_diff(spark):
    assert values(spark, f.like_flag("s", "%Cash%"), [("Cash loans",), ("X",), (None,)],
                  "s string") == [1, 0, 0]
    assert values(spark, f.coalesce_key("x", "y"), [(None, 2), (1, 2)], "x int, y int") == [2, 1]
    assert values(spark, f.diff("x", "y"), [(3, 2), (None, 2)], "x int, y int") == [1, None]


def test_conditional_aggregates(spark, one):
    df = spark.createDataFrame([(1, "a"), (3, "a"), (5, "b"), (None, "b")], "x int, k string")
    is_a = F.col("k") == "a"
    got = one(df.agg(
        f.count_if(is_a).alias("n"), f.any_flag(F.col("x") > 4).alias("any"),
        f.all_flag(F.col("x") > 0).alias("all"), f.avg_where("x", is_a).alias("subset"),
        f.avg_where("x", is_a, els=0).alias("zeros"), f.span("x").alias("span"),
        f.share(is_a).alias("share"), f.pct_share(F.col("x") == 1).alias("pct")))
    assert got == {"n": 2, "any": 1, "all": 0, "subset": 2.0, "zeros": 1.0, "span": 4,
                   "share": 0.5, "pct": 25.0}
    empty = one(df.where("false").agg(f.count_if(is_a).alias("n"), f.share(is_a).alias("s"),
                                      f.avg_where("x", is_a).alias("a")))
    assert empty == {"n": 0, "s": 0.0, "a": None}


def test_highest_code_and_weighted_average(spark, one):
    df = spark.createDataFrame([("C", 1.0, 2), ("4", 4.0, 1), (None, None, 7)],
                               "s string, v double, w int")
    got = one(df.agg(F.max(f.code_to_int("s", ["4"])).alias("m"), f.weighted_avg("v", "w").alias("a")))
    assert got == {"m": 4, "a": 2.0}


def test_projection_operators(spark, rows):
    df = spark.createDataFrame([("Y", 365243, 1), ("N", -730, 2), (None, None, 3)],
                               "car string, days int, id int")
    flags = projection.encode_flag(df, ["car", "absent"], partial=True)
    with pytest.raises(ValueError, match="absent"):
        projection.encode_flag(df, ["car", "absent"])
    with pytest.raises(ValueError, match="absent"):
        projection.fill_defaults(df, {"absent": 1})
    assert rows(flags.select("id", "car")) == [(1, 1), (2, 0), (3, 0)]
    out = projection.sentinel(df, "days", 365243, 0.0, f.days_to_years("days", digits=2), "hit", "years")
    assert rows(out.select("id", "years", "hit")) == [(1, 0.0, 1), (2, 2.0, 0), (3, None, 0)]
    assert projection.rename_project(df, {"id": "key"}).columns == ["key"]
    filled = projection.fill_defaults(df, {"car": "N", "days": 0, "absent": 1}, partial=True)
    assert rows(filled.select("id", "car", "days"))[2] == (3, "N", 0)
    assert rows(projection.tag(df, "t", "x").select("t").distinct()) == [("x",)]
    assert projection.preview(df, 2).count() == 2
    assert projection.columns_by_type(df, exclude=["id"]) == ["days"]
    assert projection.columns_by_type(df, ("string",)) == ["car"]
