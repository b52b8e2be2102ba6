"""Analyses known from their written definition only.

Each is a default rate over a derived dimension or a mean per label value.
Where the text gives thresholds and labels they are used as given; where it
names a bucket without a bound the choice is stated next to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.functions import bucketize, cross_profile, flag, ratio, sum_flags
from creditloom.operators.quantiles import exact_percentile
from creditloom.operators.reports import compare_by_target, rates_in_one_scan, target_rate
from creditloom.plans import bureau as b
from creditloom.plans import previous as p
from creditloom.plans.exploration import CONTACT_FLAGS, credit_to_income

# ---- fixed values -----------------------------------------------------------
HOUR_GROUPS = [(5, "Dini Hari (0-5)"), (11, "Pagi (6-11)"), (17, "Siang (12-17)")]
HOUR_REST = "Malam (18-23)"
UNACCOMPANIED = ["Unaccompanied", "None"]
UTILIZATION_LABELS = {"high": "Tinggi (>70%)", "mid": "Sedang (30-70%)", "low": "Rendah (<30%)",
                      "none": "Tidak ada limit"}
TREND_LABELS = {"worse": "Memburuk", "better": "Membaik", "stable": "Stabil"}
HISTORY_GROUPS = [(6, "Pendek (≤6 bulan)"), (12, "Sedang (7-12 bulan)"),
                  (24, "Panjang (13-24 bulan)")]
HISTORY_REST = "Sangat Panjang (>24 bulan)"
DEBT_GROUPS = [(1, "Ringan (<1x)"), (3, "Sedang (1-3x)"), (5, "Berat (3-5x)")]
DEBT_REST = "Sangat Berat (>5x)"
ACTIVE_SHARES = [(0.25, "0-25%"), (0.5, "25-50%"), (0.75, "50-75%")]
ACTIVE_REST = ">75%"
REMAINING_GROUPS = [(0, "0"), (6, "1-6"), (12, "7-12")]
REMAINING_REST = ">12"
POS_PROFILES = {(1, 1): "High Remaining + DPD", (1, 0): "High Remaining", (0, 1): "DPD"}
POS_REST = "Normal"
LATE_GROUPS = [(0, "Tepat Waktu"), (5, "Keterlambatan Ringan"), (15, "Keterlambatan Sedang")]
LATE_REST = "Keterlambatan Berat"
HEAVY_UNDERPAID = -500
EXTREME_BORROWING = 100000
NO_DATA = "Tidak ada data"


def steps(col: Column | str, bounds, rest: str, strict: bool = False) -> Column:
    """Label of the first bound not exceeded; NULL has a label of its own."""
    value = F.col(col) if isinstance(col, str) else col
    rules = [(value.isNull(), NO_DATA)]
    rules += [((value < bound) if strict else (value <= bound), label) for bound, label in bounds]
    return bucketize(rules, rest)


def with_label(features: DataFrame, app: DataFrame, *carry: str) -> DataFrame:
    """Feature rows of known loans with the label (and further columns)."""
    return features.join(app.select("loanId", "target", *carry), "loanId", "inner")


# ---- application ------------------------------------------------------------
def rate_by_hour_group(app: DataFrame) -> DataFrame:
    return target_rate(app, {"app_time_group": steps("hourApp", HOUR_GROUPS, HOUR_REST)})


def rate_reports(app: DataFrame) -> DataFrame:
    """The application reports by one or two dimensions, from one scan."""
    return rates_in_one_scan(app, {
        "contract": ["contractType"], "suite": ["suiteType"], "assets": ["ownCar", "ownRealty"],
        "income_type": ["incomeType"], "weekday": ["weekdayApp"], "region": ["regionRate"],
        "hour_group": {"app_time_group": steps("hourApp", HOUR_GROUPS, HOUR_REST)},
        "commute": ["liveNotWork", "liveCityNotWork"]})


def rate_by_weekday(app: DataFrame) -> DataFrame:
    return target_rate(app, ["weekdayApp"])


def rate_by_region(app: DataFrame) -> DataFrame:
    return target_rate(app, ["regionRate"], extra={
        "avg_income": F.avg("incomeTotal"), "avg_credit": F.avg("creditAmt"),
        "avg_ratio": F.avg(credit_to_income())})


def rate_by_commute(app: DataFrame) -> DataFrame:
    return target_rate(app, ["liveNotWork", "liveCityNotWork"])


def recommended_flags(app: DataFrame) -> DataFrame:
    """Flags the analysis recommends but the production table lacks."""
    c = F.col
    return app.select(
        "loanId",
        flag(~c("suiteType").isin(UNACCOMPANIED)).alias("is_accompanied"),
        flag(c("creditAmt") > c("goodsPrice") * 1.2).alias("has_extra_fees"),
        flag((c("daysReg") > -365) | (c("daysIdPub") > -365)).alias("is_recent_change"),
        flag(sum_flags(CONTACT_FLAGS) >= 3).alias("is_contact_complete"),
        flag(credit_to_income() > 4).alias("is_high_debt_to_income"),
    )


# ---- bureau -----------------------------------------------------------------
def bureau_means(bureau: DataFrame, balance: DataFrame, app: DataFrame) -> DataFrame:
    """Means per label of what a loan holds at the bureau, each record counted once."""
    records = b.bureau_with_history(bureau, balance)
    per_loan = records.groupBy("loanId").agg(
        F.count_if(F.col("creditActive") == "Active").alias("active"),
        F.sum("overdueSum").alias("overdue"), F.sum("creditSum").alias("credit"),
        F.sum("debtSum").alias("debt"),
        F.sum(F.coalesce("delinquent", F.lit(0))).alias("delinquent"))
    return compare_by_target(with_label(per_loan, app), {
        "avg_active_loans": F.col("active"), "avg_overdue_sum": F.col("overdue"),
        "avg_credit_sum": F.col("credit"), "avg_debt_sum": F.col("debt"),
        "avg_delinquent_months": F.col("delinquent")})


def bureau_rate_by(bureau: DataFrame, balance: DataFrame, app: DataFrame,
                   dims: dict[str, Column | str]) -> DataFrame:
    """Default rate over joined bureau-and-balance rows by record-level dimensions.

    Records are folded to (loan, dimension) with their row count before the
    label is joined, so neither the fan-out nor a busy loan is shuffled.
    """
    records = b.bureau_with_history(bureau, balance)
    keys = [(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in dims.items()]
    folded = records.groupBy("loanId", *keys).agg(F.sum("weight").alias("rows"))
    return target_rate(with_label(folded, app), list(dims), weight="rows")


def utilization_group() -> Column:
    """Debt over limit in bands; a record without a positive limit has no band.

    With a limit but without a known debt the band is unknown.
    """
    used = b.utilization()
    unlimited = F.coalesce(F.col("creditLimit"), F.lit(0)) <= 0
    return bucketize([(unlimited, UTILIZATION_LABELS["none"]), (used.isNull(), NO_DATA),
                      (used > 0.7, UTILIZATION_LABELS["high"]),
                      (used >= 0.3, UTILIZATION_LABELS["mid"])], UTILIZATION_LABELS["low"])


def overdue_severity() -> Column:
    return bucketize([(F.col("maxOverdue") > 0, "Pernah tunggakan")], "Tanpa tunggakan")


def update_recency() -> Column:
    """The text fixes 30 days only; everything older is one bucket."""
    return steps(-F.col("daysCreditUpdate"), [(30, "≤ 30 hari")], "> 30 hari")


def loan_histories(bureau: DataFrame, balance: DataFrame, app: DataFrame, *carry: str) -> DataFrame:
    """Per-loan balance history with label; loans without balance rows are left out."""
    records = b.bureau_with_history(bureau, balance)
    per_loan = records.where(F.col("months").isNotNull()).groupBy("loanId").agg(
        F.sum("delinquent").alias("delinquent_months"),
        ratio(F.sum("recentCodeSum"), F.sum("recentMonths"), None).alias("recent_status_avg"),
        ratio(F.sum("codeSum"), F.sum("months"), None).alias("avg_status_score"),
        (F.max("lastMonth") - F.min("firstMonth")).alias("history_length"))
    return with_label(per_loan, app, *carry)


def history_means(histories: DataFrame) -> DataFrame:
    """Means per label of the loans' balance histories."""
    return compare_by_target(histories, {
        "avg_history_length": F.col("history_length"), "avg_status_score": F.col("avg_status_score"),
        "avg_recent_status": F.col("recent_status_avg")})


def record_means(bureau: DataFrame, app: DataFrame) -> DataFrame:
    """Means per label of what a loan's bureau records hold: overdue days, worst overdue, utilization."""
    per_loan = bureau.groupBy(F.col("SK_ID_CURR").alias("loanId")).agg(
        F.avg("CREDIT_DAY_OVERDUE").alias("days"), F.max("AMT_CREDIT_MAX_OVERDUE").alias("worst"),
        F.avg(ratio("AMT_CREDIT_SUM_DEBT", "AMT_CREDIT_SUM_LIMIT", on_zero=None)).alias("used"))
    return compare_by_target(with_label(per_loan, app), {
        "avg_overdue_days": F.col("days"), "avg_max_overdue": F.col("worst"), "avg_utilization": F.col("used")})


def delinquent_category(histories: DataFrame) -> DataFrame:
    months = F.col("delinquent_months")
    return target_rate(histories, {"delinquent_category": bucketize(
        [(months == n, str(n)) for n in range(3)], "3+")})


def trend_group(histories: DataFrame) -> DataFrame:
    """Recent months against all months; no recent months means stable."""
    recent, overall = F.col("recent_status_avg"), F.col("avg_status_score")
    return target_rate(histories, {"trend": bucketize(
        [(recent > overall, TREND_LABELS["worse"]), (recent < overall, TREND_LABELS["better"])],
        TREND_LABELS["stable"])})


def history_group(histories: DataFrame) -> DataFrame:
    return target_rate(histories, {
        "history_length_group": steps("history_length", HISTORY_GROUPS, HISTORY_REST)})


def composite_score(bureau: DataFrame, balance: DataFrame, cap: float | None = 0.99,
                    log: bool = False) -> DataFrame:
    """Sum of min-max scaled overdue days, debt and delinquent months per loan.

    The text does not say how to normalise; min-max is the choice here, with
    the advised remedies: values capped at an exact quantile, and log scale.
    """
    metrics = ["overdue_days", "debt_sum", "delinquent_months"]
    records = b.bureau_with_history(bureau, balance)
    loans = records.groupBy("loanId").agg(
        F.coalesce(F.sum("overdueDays"), F.lit(0)).cast("double").alias("overdue_days"),
        F.coalesce(F.sum("debtSum"), F.lit(0)).cast("double").alias("debt_sum"),
        F.sum(F.coalesce("delinquent", F.lit(0))).cast("double").alias("delinquent_months"))
    if cap is not None:
        caps = exact_percentile(loans.unpivot(["loanId"], metrics, "metric", "value"),
                                ["metric"], "value", cap, "cap", interpolate=False)
        limits = caps.agg(F.map_from_entries(F.collect_list(F.struct("metric", "cap"))))
        loans = loans.withColumn("_caps", limits.scalar())
        loans = loans.select("loanId", *[F.least(m, F.try_element_at("_caps", F.lit(m))).alias(m)
                                         for m in metrics])
    if log:
        loans = loans.withColumns({m: F.log1p(m) for m in metrics})
    ranges = loans.agg(F.struct(*[F.struct(F.min(m).alias("lo"), F.max(m).alias("hi")).alias(m)
                                  for m in metrics]))
    scaled = loans.withColumn("_ranges", ranges.scalar())

    def unit(m: str) -> Column:
        lo, hi = F.col(f"_ranges.{m}.lo"), F.col(f"_ranges.{m}.hi")
        return ratio(F.col(m) - lo, hi - lo)

    return scaled.select("loanId", *metrics,
                         (unit(metrics[0]) + unit(metrics[1]) + unit(metrics[2])).alias("composite_score"))


def debt_ratio_bucket(bureau: DataFrame, app: DataFrame) -> DataFrame:
    """Default rate by total bureau debt over income."""
    debts = bureau.groupBy(F.col("SK_ID_CURR").alias("loanId")).agg(
        F.sum("AMT_CREDIT_SUM_DEBT").alias("debt"))
    loans = with_label(debts, app, "incomeTotal")
    return target_rate(loans, {"debt_ratio_bucket": steps(
        ratio("debt", "incomeTotal", on_zero=None), DEBT_GROUPS, DEBT_REST, strict=True)})


def active_ratio_bucket(bureau: DataFrame, app: DataFrame) -> DataFrame:
    counts = bureau.groupBy(F.col("SK_ID_CURR").alias("loanId")).agg(
        ratio(F.count_if(F.col("CREDIT_ACTIVE") == "Active"), F.count("SK_ID_BUREAU"))
        .alias("active_ratio"))
    return target_rate(with_label(counts, app), {
        "active_ratio_bucket": steps("active_ratio", ACTIVE_SHARES, ACTIVE_REST)})


# ---- earlier applications, POS, instalments, cards --------------------------
def _rows_by(df: DataFrame, app: DataFrame, dims: dict[str, Column | str]) -> DataFrame:
    """Default rate over detail rows, folded to (loan, dimension) before the join."""
    keys = [(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in dims.items()]
    folded = df.groupBy(F.col("SK_ID_CURR").alias("loanId"), *keys).agg(
        F.count(F.lit(1)).alias("rows"))
    return target_rate(with_label(folded, app), list(dims), weight="rows")


def refusals_by_target(previous: DataFrame, app: DataFrame) -> DataFrame:
    return compare_by_target(with_label(p.previous_risk(previous), app),
                             {"avg_refused_count": F.col("refused_count")})


def rate_by_reject_reason(previous: DataFrame, app: DataFrame) -> DataFrame:
    return _rows_by(previous, app, {"reject_reason": "CODE_REJECT_REASON"})


def rate_by_decision_recency(previous: DataFrame, app: DataFrame) -> DataFrame:
    return _rows_by(previous, app, {
        "decision_recency": steps(-F.col("DAYS_DECISION"), [(30, "≤ 30 hari")], "> 30 hari")})


def remaining_bucket(pos: DataFrame, app: DataFrame) -> DataFrame:
    return _rows_by(pos, app, {"remaining_installment_bucket": steps(
        "CNT_INSTALMENT_FUTURE", REMAINING_GROUPS, REMAINING_REST)})


def pos_risk_profile(pos: DataFrame, app: DataFrame) -> DataFrame:
    profile = cross_profile(flag(F.col("CNT_INSTALMENT_FUTURE") > 12), flag(F.col("SK_DPD") > 0),
                            POS_PROFILES, POS_REST)
    return _rows_by(pos, app, {"risk_profile": profile})


def installment_groups(installments: DataFrame, app: DataFrame) -> DataFrame:
    """Per-loan lateness, payment difference and highest schedule version, with label."""
    per_loan = installments.groupBy(F.col("SK_ID_CURR").alias("loanId")).agg(
        F.avg(F.col("DAYS_ENTRY_PAYMENT") - F.col("DAYS_INSTALMENT")).alias("late_days"),
        F.avg(F.col("AMT_PAYMENT") - F.col("AMT_INSTALMENT")).alias("payment_diff"),
        F.max("NUM_INSTALMENT_VERSION").alias("max_version"))
    return with_label(per_loan, app)


def installment_means(installments: DataFrame, app: DataFrame) -> DataFrame:
    """Means per label of lateness, its share, the payment difference, versions and instalments."""
    per_loan = installments.groupBy(F.col("SK_ID_CURR").alias("loanId")).agg(
        F.avg(F.col("DAYS_ENTRY_PAYMENT") - F.col("DAYS_INSTALMENT")).alias("late_days"),
        F.avg(F.when(F.col("DAYS_ENTRY_PAYMENT") > F.col("DAYS_INSTALMENT"), 1.0).otherwise(0.0)).alias("late_ratio"),
        F.avg(F.col("AMT_PAYMENT") - F.col("AMT_INSTALMENT")).alias("payment_diff"),
        F.avg("NUM_INSTALMENT_VERSION").alias("version"), F.count(F.lit(1)).alias("n"))
    return compare_by_target(with_label(per_loan, app), {
        "avg_late_days": F.col("late_days"), "avg_late_ratio": F.col("late_ratio"),
        "avg_payment_diff": F.col("payment_diff"), "avg_version": F.col("version"),
        "avg_installment_count": F.col("n")})


def underpaid_rate(installments: DataFrame, app: DataFrame) -> DataFrame:
    """Default rate by how often a loan was paid short."""
    return target_rate(with_label(p.installment_risk(installments), app), ["inst_underpaid_freq"])


def late_bucket(groups: DataFrame) -> DataFrame:
    """Between 5 and 6 days no bound is given: 6 to 15 days is the middle band."""
    late = F.col("late_days")
    return target_rate(groups, {"late_bucket": bucketize(
        [(late.isNull(), NO_DATA), (late <= 0, LATE_GROUPS[0][1]), (late < 6, LATE_GROUPS[1][1]),
         (late <= 15, LATE_GROUPS[2][1])], LATE_REST)})


def payment_diff_bucket(groups: DataFrame) -> DataFrame:
    d = F.col("payment_diff")
    return target_rate(groups, {"payment_diff_bucket": bucketize(
        [(d.isNull(), NO_DATA), (d < HEAVY_UNDERPAID, "Kurang Bayar Berat"),
         (d < 0, "Kurang Bayar Ringan"), (d == 0, "Sesuai")], "Lebih Bayar")})


def version_group(groups: DataFrame) -> DataFrame:
    v = F.col("max_version")
    return target_rate(groups, {"max_version_group": bucketize(
        [(v.isNull(), NO_DATA), (v == 0, "Versi 0"), (v == 1, "Versi 1")], "Versi 2+")})


def card_groups(card: DataFrame, app: DataFrame) -> DataFrame:
    """Per-loan card averages with label."""
    per_loan = card.groupBy(F.col("SK_ID_CURR").alias("loanId")).agg(
        F.avg(p.card_utilization()).alias("utilization"),
        F.avg("AMT_DRAWINGS_CURRENT").alias("draw"), F.avg("AMT_PAYMENT_CURRENT").alias("pay"),
        F.avg(F.col("AMT_DRAWINGS_CURRENT") - F.col("AMT_PAYMENT_CURRENT")).alias("borrowed"))
    return with_label(per_loan, app)


def card_means(card: DataFrame, app: DataFrame) -> DataFrame:
    """Mean card utilization per label, over all months and in the latest one."""
    used = p.card_utilization()
    per_loan = card.groupBy(F.col("SK_ID_CURR").alias("loanId")).agg(
        F.avg(used).alias("used"), F.avg(F.when(F.col("MONTHS_BALANCE") == -1, used)).alias("recent"))
    return compare_by_target(with_label(per_loan, app), {
        "avg_utilization": F.col("used"), "recent_utilization": F.col("recent")})


def card_utilization_bucket(groups: DataFrame) -> DataFrame:
    u = F.col("utilization")
    return target_rate(groups, {"utilization_bucket": bucketize(
        [(u.isNull(), UTILIZATION_LABELS["none"]), (u > 0.7, UTILIZATION_LABELS["high"]),
         (u >= 0.3, UTILIZATION_LABELS["mid"])], UTILIZATION_LABELS["low"])})


def pay_ratio_bucket(groups: DataFrame) -> DataFrame:
    """Only the 0.4 bound is given; paying at least what was drawn is split off.

    A loan that drew money and has no recorded payment has no known ratio.
    """
    paid = ratio("pay", "draw", on_zero=None)
    return target_rate(groups, {"pay_ratio_bucket": bucketize(
        [(F.coalesce("draw", F.lit(0.0)) <= 0, "Tidak Ada Penarikan"), (F.col("pay").isNull(), NO_DATA),
         (paid < 0.4, "Pembayaran Sangat Rendah"), (paid < 1, "Pembayaran Sebagian")],
        "Pembayaran Penuh")})


def net_borrowing_bucket(groups: DataFrame) -> DataFrame:
    n = F.col("borrowed")
    return target_rate(groups, {"net_borrowing_bucket": bucketize(
        [(n.isNull(), NO_DATA), (n <= 0, "Tidak Menambah Hutang"),
         (n < EXTREME_BORROWING, "Menambah Hutang Ringan")], "Menambah Hutang Berat")})
