import pytest
from pyspark.sql import functions as F

from creditloom.operators import reports
from creditloom.operators.reports import compare_by_target, target_rate, top_k, union_all
from creditloom.plans import documented as k
from creditloom.plans import exploration as j

DETAIL = [("a", 1), ("a", 0), ("a", None), ("b", 1), (None, 0), (None, None)]


def test_weighted_rate_equals_detail_rate(spark, rows):
    detail = spark.createDataFrame(DETAIL, "d string, target int")
    folded = detail.groupBy("d", "target").agg(F.count(F.lit(1)).alias("w"))
    want = rows(target_rate(detail, ["d"]))
    assert rows(target_rate(folded, ["d"], weight="w")) == want
    assert want == [(None, 2, 0.0), ("a", 3, 0.5), ("b", 1, 1.0)]


def test_rate_is_ordered_and_carries_extras(spark):
    df = spark.createDataFrame(DETAIL, "d string, target int")
    got = target_rate(df, {"dim": F.upper("d")}, extra={"most": F.max("target")}, count_name="n",
                      rate_name="r").collect()
    assert [(r.dim, r.n, r.r, r.most) for r in got] == [("B", 1, 1.0, 1), ("A", 3, 0.5, 1), (None, 2, 0.0, 0)]


def test_compare_by_target(spark, rows):
    df = spark.createDataFrame([(1, 2.0), (1, 4.0), (0, None)], "target int, x double")
    assert rows(compare_by_target(df, {"m": F.col("x")})) == [(0, None), (1, 3.0)]


def test_top_k_breaks_ties_and_skips_nulls(spark):
    df = spark.createDataFrame([(3, 5), (1, 5), (2, 9), (4, None)], "id int, v int").repartition(4)
    assert [r.id for r in top_k(df, "v", 2, tie_break=["id"]).collect()] == [2, 1]
    assert [r.id for r in top_k(df, "v", 2, desc=False, tie_break=["id"]).collect()] == [1, 3]
    both = union_all(top_k(df, "v", 1, tie_break=["id"]), top_k(df, F.col("v"), 1, desc=False, tie_break=["id"]))
    assert [r.id for r in both.collect()] == [2, 1]
    assert "TakeOrderedAndProject" in top_k(df, "v", 2, tie_break=["id"])._jdf.queryExecution().executedPlan().toString()


def labels(spark, col, values, schema):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(col).collect()]


def test_bucket_bounds(spark):
    assert labels(spark, k.steps("x", k.HISTORY_GROUPS, k.HISTORY_REST), [6, 7, 12, 24, 25, None], "x int") == [
        "Pendek (≤6 bulan)", "Sedang (7-12 bulan)", "Sedang (7-12 bulan)", "Panjang (13-24 bulan)",
        "Sangat Panjang (>24 bulan)", "Tidak ada data"]
    assert labels(spark, k.steps("x", k.DEBT_GROUPS, k.DEBT_REST, strict=True), [0.5, 1.0, 3.0, 5.0],
                  "x double") == ["Ringan (<1x)", "Sedang (1-3x)", "Berat (3-5x)", "Sangat Berat (>5x)"]
    assert labels(spark, k.steps("x", k.HOUR_GROUPS, k.HOUR_REST), [0, 5, 6, 11, 12, 18], "x int") == [
        "Dini Hari (0-5)", "Dini Hari (0-5)", "Pagi (6-11)", "Pagi (6-11)", "Siang (12-17)", "Malam (18-23)"]


def groups(spark, report, column, values):
    df = spark.createDataFrame([(v, 1) for v in values], f"{column} double, target int")
    return {r[0]: r.total for r in report(df).collect()}


def test_documented_buckets(spark):
    assert groups(spark, k.late_bucket, "late_days", [0.0, 5.5, 6.0, 15.0, 15.5, None]) == {
        "Tepat Waktu": 1, "Keterlambatan Ringan": 1, "Keterlambatan Sedang": 2, "Keterlambatan Berat": 1,
        "Tidak ada data": 1}
    assert groups(spark, k.payment_diff_bucket, "payment_diff", [-501.0, -500.0, 0.0, 1.0]) == {
        "Kurang Bayar Berat": 1, "Kurang Bayar Ringan": 1, "Sesuai": 1, "Lebih Bayar": 1}
    assert groups(spark, k.version_group, "max_version", [0.0, 1.0, 2.0, 9.0]) == {
        "Versi 0": 1, "Versi 1": 1, "Versi 2+": 2}
    assert groups(spark, k.net_borrowing_bucket, "borrowed", [0.0, 1.0, 100000.0]) == {
        "Tidak Menambah Hutang": 1, "Menambah Hutang Ringan": 1, "Menambah Hutang Berat": 1}
    assert groups(spark, k.card_utilization_bucket, "utilization", [0.29, 0.3, 0.7, 0.71, None]) == {
        "Rendah (<30%)": 1, "Sedang (30-70%)": 2, "Tinggi (>70%)": 1, "Tidak ada limit": 1}
    assert groups(spark, k.delinquent_category, "delinquent_months", [0.0, 1.0, 2.0, 3.0, 8.0]) == {
        "0": 1, "1": 1, "2": 1, "3+": 2}


def test_goods_gap_reports(spark):
    app = spark.createDataFrame(
        [(1, 10.0, 5.0, 0), (2, 10.0, 15.0, 1), (3, 7.0, 7.0, 0), (4, 9.0, 0.0, 0), (5, 9.0, None, 1)],
        "loanId int, creditAmt double, goodsPrice double, target int")
    counts = j.goods_price_counts(app).first()
    assert (counts.applicant_barang, counts.applicant_nonBarang) == (4, 2)
    assert [r.loanId for r in j.gap_extremes(app, 2).collect()] == [1, 3]
    assert [r.loanId for r in j.zero_gap(app).collect()] == [3]
    both = j.gap_extremes_combined(app, 1, with_target=True).collect()
    assert [(r.case_type, r.loanId, r.avg_target) for r in both] == [
        (j.POSITIVE_GAP, 1, 0.0), (j.NEGATIVE_GAP, 2, 1.0)]


def test_reports_of_one_scan_equal_reports_of_their_own(spark, rows):
    df = spark.createDataFrame([(0, "a", 1, 1.0), (1, "a", None, 2.0), (None, None, 2, 3.0), (1, "b", 2, None), (0, None, None, 1.0)] * 3,
                               "target int, x string, y int, z double")
    wanted = {"x": ["x"], "xy": ["x", "y"], "big": {"big": F.col("z") > 1.5}, "x_big": {"x": "x", "big": F.col("z") > 1.5}}
    together = reports.rates_in_one_scan(df, wanted)
    for name, dims in wanted.items():
        alone = reports.target_rate(df, dims)
        assert rows(reports.report_of(together, name, list(dims))) == rows(alone)
    plan = together._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1 and "Expand" in plan
    with pytest.raises(ValueError):
        reports.rates_in_one_scan(df, {"a": ["x", "y"], "b": ["y", "x"]})
