import numpy as np
import pytest
from pyspark.sql import functions as F

from creditloom.operators import cleaning, quantiles
from creditloom.operators.quantiles import column_percentiles, exact_percentile


def frame(spark, columns):
    names = list(columns)
    data = [tuple(None if v is None else float(v) for v in row) for row in zip(*columns.values())]
    return spark.createDataFrame(data, ", ".join(f"{n} double" for n in names))


@pytest.fixture(params=["direct", "radix"])
def way(request, monkeypatch):
    """Both ways give the same results; small inputs are sent through the passes too."""
    if request.param == "radix":
        monkeypatch.setattr(quantiles, "DIRECT", 3)
        monkeypatch.setattr(quantiles, "DIRECT_CELLS", 0)


@pytest.mark.parametrize("p", [0.0, 0.5, 0.99])
def test_exact_percentile_small(spark, p, way):
    """One group per size, with many repeated values."""
    sizes = [1, 2, 3, 4, 7, 10, 199, 200, 801, 5000]
    groups = {n: np.random.default_rng(n).integers(0, max(2, n // 3), n).astype(float) for n in sizes}
    df = spark.createDataFrame([(n, float(v)) for n, x in groups.items() for v in x], "n int, v double")
    for n, got in exact_percentile(df, ["n"], "v", p).collect():
        assert got == pytest.approx(np.percentile(groups[n], 100 * p), abs=1e-9)
    for n, got in exact_percentile(df, ["n"], "v", p, interpolate=False).collect():
        assert got == np.percentile(groups[n], 100 * p, method="inverted_cdf")


@pytest.mark.parametrize("shape", ["spread", "heavy", "two_values", "outliers", "tiny"])
def test_radix_selection_on_many_values(spark, shape):
    """Groups above the direct size; one value may hold a third."""
    n = 2 * quantiles.DIRECT + 5
    rng = np.random.default_rng(7)
    x = {"spread": rng.normal(size=n), "heavy": np.where(rng.random(n) < 0.34, 0.25, rng.random(n)),
         "two_values": (rng.random(n) < 0.5).astype(float), "tiny": rng.integers(-5, 6, n) * 5e-324,
         "outliers": np.where(rng.random(n) < 0.001, -1e300, rng.exponential(size=n))}[shape]
    import pandas as pd
    df = spark.createDataFrame(pd.DataFrame({"g": np.arange(n) % 2, "v": x})).repartition(16)
    for p in (0.5, 0.9):
        for g, got in exact_percentile(df, ["g"], "v", p).collect():
            assert got == pytest.approx(np.percentile(x[g::2], 100 * p), rel=1e-12, abs=0)


def test_zeros_of_both_signs_and_infinities_are_in_order(spark, way):
    df = spark.createDataFrame([(v,) for v in (-0.0, 0.0, float("-inf"), float("inf"), -1.5, 2.5, 2.5)], "v double")
    got = [exact_percentile(df, [], "v", i / 6, interpolate=False).first()[0] for i in range(7)]
    assert got == [float("-inf"), -1.5, 0.0, 0.0, 2.5, 2.5, float("inf")]


def test_exact_percentile_groups(spark, rows, way):
    df = spark.createDataFrame(
        [("a", 1.0), ("a", 2.0), (None, 5.0), (None, None), ("b", None)], "g string, v double")
    assert rows(exact_percentile(df, ["g"], "v")) == [(None, 5.0), ("a", 1.5)]
    assert exact_percentile(df.where("false"), ["g"], "v").count() == 0
    many = spark.range(9000).selectExpr("id % 3000 AS g", "id AS v")
    assert exact_percentile(many, ["g"], "v").where("percentile = g + 3000").count() == 3000


@pytest.mark.parametrize("p", [0.5, 0.9])
def test_column_percentiles_equal_numpy(spark, p, way):
    rng, n = np.random.default_rng(1), 30_011
    import pandas as pd
    data = pd.DataFrame({"a": rng.normal(size=n), "same": np.ones(n), "few": rng.integers(0, 3, n).astype(float),
                         "none": [None] * n})
    data.loc[::7, "a"] = None
    df = spark.createDataFrame(data, "a double, same double, few double, none double").repartition(6)
    df = df.select([F.when(~F.isnan(c), F.col(c)).alias(c) for c in df.columns])
    for interpolate, method in ((True, "linear"), (False, "inverted_cdf")):
        got = {r["column"]: r.m for r in column_percentiles(df, data.columns, p, "m", interpolate).collect()}
        want = {c: np.percentile(data[c].dropna().astype(float), 100 * p, method=method) for c in ("a", "same", "few")}
        assert got == pytest.approx(want)
    assert column_percentiles(df.where("false"), ["a"], p).count() == 0


def test_radix_selection_leaves_only_stored_ranges_to_read(spark, monkeypatch):
    """One job a pass: the result holds no window and reads no row of the frame again."""
    monkeypatch.setattr(quantiles, "DIRECT_CELLS", 0)
    df = spark.range(5000).selectExpr("CAST(id AS DOUBLE) AS a", "SQRT(id) AS b")
    medians = column_percentiles(df, ["a", "b"])
    plan = medians._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Range (" not in plan and "Expand" not in plan
    assert medians.inputFiles() and all("/ranges-" in f for f in medians.inputFiles())
    assert {r["column"]: r.percentile for r in medians.collect()} == pytest.approx(
        {"a": 2499.5, "b": (2499 ** 0.5 + 2500 ** 0.5) / 2})


def test_radix_selection_over_doubles_of_all_sizes(spark, way):
    """Random bits: both signs, subnormal numbers, infinities and NaN, which is the greatest."""
    bits = np.random.default_rng(11).integers(-2 ** 63, 2 ** 63, 4001)
    x = np.concatenate([bits.view(float), bits[:50] % 2 ** 40 * 5e-324, [np.inf, -np.inf, 0.0, -0.0, np.nan, np.nan]])
    x = np.sort(x)
    df = spark.createDataFrame([(float(v),) for v in x], "v double").repartition(5)
    for rank in (0, 1500, 2030, 2100, len(x) - 1):
        got = exact_percentile(df, [], "v", rank / (len(x) - 1), interpolate=False).first()[0]
        want = x[max(int(np.ceil(rank / (len(x) - 1) * len(x))) - 1, 0)]
        assert got == want or (np.isnan(got) and np.isnan(want))


def test_numeric_imputation_strategies(spark):
    df = frame(spark, {"x": [1, 2, None, 10, 3], "y": [None] * 5, "z": [4, 4, 4, 4, 4]})
    exact = cleaning.impute_numeric(df, ["x", "y", "z"], "median").collect()
    assert [r.x for r in exact] == [1.0, 2.0, 2.5, 10.0, 3.0]
    assert all(r.y is None for r in exact), "a column without values has no median"
    lower = cleaning.impute_numeric(df, ["x"], "approx_median", 0.0).collect()
    assert [r.x for r in lower] == [1.0, 2.0, 2.0, 10.0, 3.0]
    with pytest.raises(ValueError):
        cleaning.impute_numeric(df, ["x"], "mean")
    assert cleaning.impute_numeric(df, []) is df


def test_approx_median_stays_within_rank_error(spark):
    x = np.random.default_rng(3).permutation(20000).astype(float)
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double").repartition(8)
    fill = cleaning.fit_numeric(df, ["x"]).first().fill
    assert abs(fill - 9999.5) <= 0.01 * 20000


def test_imputed_integers_become_double_with_and_without_nulls(spark):
    df = spark.createDataFrame([(1, 1), (2, None)], "a int, b int")
    assert dict(cleaning.impute_numeric(df, ["a", "b"]).dtypes) == {"a": "double", "b": "double"}


def test_statistics_can_come_from_another_split(spark):
    train, test = frame(spark, {"x": [1, 3, 5]}), frame(spark, {"x": [None, 100]})
    assert [r.x for r in cleaning.impute_numeric(test, ["x"], "median", fit_on=train).collect()] == [3.0, 100.0]


@pytest.mark.parametrize("strategy", ["median", "approx_median"])
def test_statistics_of_splits_are_fitted_side_by_side(spark, strategy, way):
    df = spark.createDataFrame([(True, 1.0, "a"), (True, 3.0, "a"), (True, None, None), (False, None, "b"), (False, 9.0, None),
                                (False, None, "b")], "test boolean, x double, s string")
    out = cleaning.impute_mode(cleaning.impute_numeric(df, ["x"], strategy, 0.0, by="test"), ["s"], by="test")
    lower = 1.0 if strategy == "approx_median" else 2.0
    assert sorted(map(tuple, out.collect())) == [(False, 9.0, "b"), (False, 9.0, "b"), (False, 9.0, "b"),
                                                 (True, 1.0, "a"), (True, lower, "a"), (True, 3.0, "a")]


def test_mode_lets_null_compete(spark):
    df = spark.createDataFrame(
        [(None, "u", None), (None, "u", "q"), ("a", None, "p"), ("b", "v", None)],
        "most_null string, plain string, tie string")
    got = cleaning.impute_mode(df, ["most_null", "plain", "tie"]).collect()
    assert [r.most_null for r in got] == ["Unknown", "Unknown", "a", "b"]
    assert [r.plain for r in got] == ["u", "u", "u", "v"]
    assert [r.tie for r in got] == ["Unknown", "q", "p", "Unknown"]     # NULL twice, p and q once
    tie = spark.createDataFrame([(None,), ("b",), ("a",)], "s string")
    assert [r.s for r in cleaning.impute_mode(tie, ["s"]).collect()] == ["a", "b", "a"]


def test_dedup_survivor_is_deterministic(spark, rows):
    df = spark.createDataFrame([(1, 3, "x"), (1, 2, "z"), (1, 2, "y"), (2, None, "w")],
                               "k int, o int, v string")
    for parts in (1, 4):
        assert rows(cleaning.dedup_by_key(df.repartition(parts), ["k"], ["o"])) == [
            (1, 2, "y"), (2, None, "w")]
    plan = cleaning.dedup_by_key(df, ["k"], ["o"])._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert "WindowGroupLimit" in plan
    assert cleaning.dedup_by_key(df.select("k"), ["k"], ["k"]).count() == 2


def test_distinct_and_null_profile(spark, rows):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x")], "k int, v string")
    assert rows(cleaning.distinct_rows(df)) == [(1, None), (2, "x")]
    assert rows(cleaning.null_profile(df)) == [("k", 0), ("v", 2)]


def test_clean_table_fills_and_drops_copies(spark, rows):
    from creditloom.plans import cleaned
    from creditloom.schemas import RAW_TABLES

    df = spark.createDataFrame([(1, 0, None), (1, 0, "C"), (1, -1, "2")], RAW_TABLES["bureau_balance"])
    assert rows(cleaned.clean_table(df, "bureau_balance")) == [(1, -1, "2"), (1, 0, "C")]
    assert len(cleaned.default_fills("previous_application")) == 35
    assert cleaned.default_fills("previous_application")["FLAG_LAST_APPL_PER_CONTRACT"] == "N"
    for table in cleaned.KEPT:
        empty = spark.createDataFrame([], RAW_TABLES[table])
        assert cleaned.clean_table(empty, table).schema.names == RAW_TABLES[table].names


@pytest.mark.parametrize("table,record", [("bureau", "SK_ID_BUREAU"), ("previous_application", "SK_ID_PREV")])
def test_clean_table_moves_no_rows_of_unique_records(spark, rows, table, record):
    """Records that occur once are not shuffled to be compared; copies go, other rows of a record stay."""
    from creditloom.operators.projection import fill_defaults
    from creditloom.plans import cleaned

    unique = spark.createDataFrame([(i, i % 7, None if i % 3 == 0 else i / 4) for i in range(3000)],
                                   f"{record} long, SK_ID_CURR long, AMT_ANNUITY double")
    plan = cleaned.clean_table(unique, table, partial=True)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    null = unique.where("SK_ID_CURR = 1").withColumn(record, F.lit(None).cast("long"))
    # NULL and 0 are the same amount once filled.
    odd = (unique.unionByName(unique.where(f"{record} < 60")).unionByName(unique.where(f"{record} < 90").withColumn("AMT_ANNUITY", F.lit(0.0)))
           .unionByName(null).unionByName(null))
    want = fill_defaults(odd, cleaned.default_fills(table), True).distinct()
    assert rows(cleaned.clean_table(odd, table, partial=True)) == rows(want)


def test_hot_copies_are_imputed_like_any_other(spark):
    """A third of all rows in one value neither moves nor breaks the statistics."""
    df = spark.range(9000).select(F.when(F.col("id") < 3000, 7).otherwise(F.col("id")).alias("x"))
    assert cleaning.fit_numeric(df, ["x"], "median").first().fill == 4499.5
