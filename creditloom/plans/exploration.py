"""Exploration reports over the application view (see ``application_view``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.functions import bucketize, count_if, diff, pct_share, ratio, sum_flags
from creditloom.operators.projection import tag
from creditloom.operators.quantiles import exact_percentile
from creditloom.operators.reports import target_rate, top_k, union_all
from creditloom.plans.application import occupation_risk

# ---- fixed values -----------------------------------------------------------
LARGE_ANNUITY = 100000
AGE_STEPS = [(-365, "< 1 tahun"), (-1095, "1-3 tahun"), (-3650, "3-10 tahun")]
AGE_REST = "> 10 tahun"
CONTACT_FLAGS = ["flagMobil", "empPhone", "workPhone", "contMobile", "flagPhone", "flagEmail"]
POSITIVE_GAP = "Positif (Pinjaman > Harga)"
NEGATIVE_GAP = "Negatif (Uang Muka)"


def credit_to_income() -> Column:
    return ratio("creditAmt", "incomeTotal", on_zero=None)


def rate_by(app: DataFrame, *dims: str) -> DataFrame:
    """Applications and default rate by contract type, companion, assets, income type, ..."""
    return target_rate(app, dims, count_name="total_customer")


def rate_with_averages(app: DataFrame, dim: str) -> DataFrame:
    """Default rate with average income, credit and credit-to-income."""
    return target_rate(app, [dim], extra={
        "avg_income": F.avg("incomeTotal"), "avg_credit": F.avg("creditAmt"),
        "avg_ratio": F.avg(credit_to_income())})


def contract_finances(app: DataFrame) -> DataFrame:
    return app.groupBy("contractType").agg(
        F.avg("creditAmt").alias("avg_credit"), F.avg("annuityAmt").alias("avg_annuity"),
        F.avg("incomeTotal").alias("avg_income"),
        F.avg(credit_to_income()).alias("avg_debt_to_income"))


def asset_finances(app: DataFrame) -> DataFrame:
    return app.groupBy("ownCar", "ownRealty").agg(
        F.avg("incomeTotal").alias("avg_income"), F.avg("annuityAmt").alias("avg_annuity"),
        F.avg("creditAmt").alias("avg_credit"),
        F.avg(ratio("annuityAmt", "incomeTotal", on_zero=None)).alias("avg_payment_ratio"))


def annuity_distribution(app: DataFrame) -> DataFrame:
    """Annuity by home ownership; the exact median is joined from its own plan."""
    large = F.col("annuityAmt") > LARGE_ANNUITY
    summary = app.groupBy("ownRealty").agg(
        F.count(F.lit(1)).alias("totalCust"),
        F.min("annuityAmt").alias("minAnnuity"), F.max("annuityAmt").alias("maxAnnuity"),
        F.avg("annuityAmt").alias("avgAnnuity"),
        count_if(large).alias("countGt100k"), pct_share(large).alias("pctGt100k"))
    median = (exact_percentile(app, ["ownRealty"], "annuityAmt", 0.5, "median_annuity")
              .withColumnRenamed("ownRealty", "_dim"))
    return summary.join(median, F.col("ownRealty").eqNullSafe(F.col("_dim")), "left").drop("_dim")


def age_by_assets(app: DataFrame) -> DataFrame:
    return (app.groupBy("ownCar", "ownRealty")
            .agg(F.count(F.lit(1)).alias("totalCustomer"), F.avg("ageYears").alias("avgAge"))
            .orderBy("ownCar", "ownRealty"))


def family_by_assets(app: DataFrame) -> DataFrame:
    return (app.groupBy("ownCar", "ownRealty")
            .agg(F.avg("childrenCnt").alias("avg_children"),
                 F.avg("famMembers").alias("avg_family_members"), F.avg("ageYears").alias("avg_age"))
            .orderBy("ownCar", "ownRealty"))


def goods_price_counts(app: DataFrame) -> DataFrame:
    """Applications with a goods price, and with none or zero, in one pass."""
    price = F.col("goodsPrice")
    return app.agg(F.count(price).alias("applicant_barang"),
                   F.count_if((price == 0) | price.isNull()).alias("applicant_nonBarang"))


def credit_goods_gap(app: DataFrame) -> DataFrame:
    return app.where(F.col("goodsPrice") > 0).select(
        "loanId", "creditAmt", "goodsPrice", diff("creditAmt", "goodsPrice").alias("diff"), "target")


def gap_extremes(app: DataFrame, k: int = 20, desc: bool = True) -> DataFrame:
    return top_k(credit_goods_gap(app).drop("target"), "diff", k, desc, tie_break=["loanId"])


def zero_gap(app: DataFrame) -> DataFrame:
    """Loans that finance exactly the goods price."""
    return credit_goods_gap(app).drop("target").where(F.col("creditAmt") == F.col("goodsPrice"))


def gap_extremes_combined(app: DataFrame, k: int = 10, with_target: bool = False) -> DataFrame:
    """The k largest and k smallest gaps with a tag column."""
    gaps = credit_goods_gap(app)
    if with_target:
        gaps = gaps.groupBy("loanId", "creditAmt", "goodsPrice", "diff", "target").agg(
            F.avg("target").alias("avg_target"))
    gaps = gaps.drop("target")

    def side(label: str, desc: bool) -> DataFrame:
        return tag(top_k(gaps, "diff", k, desc, tie_break=["loanId"]), "case_type", label)

    return union_all(side(POSITIVE_GAP, True), side(NEGATIVE_GAP, False))


def _age_bucket(col: str, prefix: str) -> Column:
    return bucketize([(F.col(col) >= days, f"{prefix}: {label}") for days, label in AGE_STEPS],
                     f"{prefix}: {AGE_REST}")


def identity_age(app: DataFrame) -> DataFrame:
    """Default rate by age of registration and of identity document."""
    known = app.where(F.col("daysReg").isNotNull() & F.col("daysIdPub").isNotNull())
    return target_rate(known, {"reg_duration": _age_bucket("daysReg", "Reg"),
                               "id_duration": _age_bucket("daysIdPub", "ID")})


def contact_score(app: DataFrame) -> DataFrame:
    return target_rate(app, {"contact_score": sum_flags(CONTACT_FLAGS)},
                       order=[F.col("contact_score").desc()])


def occupation_rates(app: DataFrame) -> DataFrame:
    return target_rate(app, ["occupation"], extra={"avg_family_members": F.avg("famMembers")})


def occupation_groups(app: DataFrame) -> DataFrame:
    return app.select("loanId", occupation_risk("occupation").alias("occupation_risk_group"))
