"""Features from earlier applications, POS loans, instalments and credit cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.functions import (
    any_flag, avg_where, between_flag, bucketize, count_if, diff, flag, ratio, share, span,
)
from creditloom.operators.features import FeatureSpec
from creditloom.operators.joins import full_outer_merge, union_merge
from creditloom.operators.projection import rename_project

# ---- fixed values -----------------------------------------------------------
HIGH_RISK_REASONS = ["SCOFR", "LIMIT"]
RECENT_DAYS = -30
LONG_REMAINDER = 12
LONG_HISTORY = 24
MEDIUM_LATE = (6, 15)
UNDERPAID_STEPS = [(0.3, "Sering"), (0.1, "Sedang"), (0.0, "Jarang")]
NEVER_UNDERPAID = "Tidak Pernah"
HIGH_UTILIZATION = 0.7
LAST_MONTH = -1
LOW_PAY_RATIO = 0.4
EXTREME_BORROWING = 100000

LOAN_KEY = {"SK_ID_CURR": "loanId"}
PREVIOUS_COLUMNS = ["NAME_CONTRACT_STATUS", "CODE_REJECT_REASON", "DAYS_DECISION"]
POS_COLUMNS = ["SK_DPD", "CNT_INSTALMENT_FUTURE", "MONTHS_BALANCE"]
INSTALLMENT_COLUMNS = ["DAYS_ENTRY_PAYMENT", "DAYS_INSTALMENT", "AMT_PAYMENT", "AMT_INSTALMENT",
                       "NUM_INSTALMENT_VERSION"]
CARD_COLUMNS = ["AMT_BALANCE", "AMT_CREDIT_LIMIT_ACTUAL", "MONTHS_BALANCE", "AMT_DRAWINGS_CURRENT",
                "AMT_PAYMENT_CURRENT"]


def keyed(df: DataFrame, columns: list[str]) -> DataFrame:
    return rename_project(df, LOAN_KEY | {c: c for c in columns})


def _same(base: dict[str, Column], *names: str) -> dict[str, Column]:
    return {n: F.col(n) for n in names or base}


def previous_spec() -> FeatureSpec:
    refused = F.col("NAME_CONTRACT_STATUS") == "Refused"
    base = {
        "has_refused_prev": any_flag(refused),
        "refused_count": count_if(refused),
        "is_high_risk_reason": any_flag(F.col("CODE_REJECT_REASON").isin(HIGH_RISK_REASONS)),
        "is_recent_decision": any_flag(F.col("DAYS_DECISION") >= RECENT_DAYS),
    }
    return FeatureSpec("previous", base, _same(base))


def pos_spec() -> FeatureSpec:
    late = F.col("SK_DPD") > 0
    base = {
        "has_pos_dpd": any_flag(late),
        "is_pos_high_risk": any_flag((F.col("CNT_INSTALMENT_FUTURE") > LONG_REMAINDER) & late),
        "pos_history_length": span("MONTHS_BALANCE"),
    }
    derived = _same(base) | {"is_pos_long_history": flag(F.col("pos_history_length") > LONG_HISTORY)}
    return FeatureSpec("pos", base, derived)


def installment_spec() -> FeatureSpec:
    base = {
        "inst_late_ratio": share(F.col("DAYS_ENTRY_PAYMENT") > F.col("DAYS_INSTALMENT")),
        "inst_avg_late_days": F.avg(diff("DAYS_ENTRY_PAYMENT", "DAYS_INSTALMENT")),
        "inst_avg_payment_diff": F.avg(diff("AMT_PAYMENT", "AMT_INSTALMENT")),
        "inst_underpaid_share": share(F.col("AMT_PAYMENT") < F.col("AMT_INSTALMENT")),
        "is_inst_version_0": any_flag(F.col("NUM_INSTALMENT_VERSION") == 0),
    }
    underpaid = F.col("inst_underpaid_share")
    derived = {
        "inst_late_ratio": F.col("inst_late_ratio"),
        "is_inst_medium_late": between_flag("inst_avg_late_days", *MEDIUM_LATE),
        "inst_avg_payment_diff": F.col("inst_avg_payment_diff"),
        "inst_underpaid_freq": bucketize([(underpaid > t, label) for t, label in UNDERPAID_STEPS],
                                         NEVER_UNDERPAID),
        "is_inst_version_0": F.col("is_inst_version_0"),
    }
    return FeatureSpec("installment", base, derived)


def card_utilization() -> Column:
    return ratio("AMT_BALANCE", "AMT_CREDIT_LIMIT_ACTUAL", on_zero=None)


def card_spec(variant: str = "as_coded") -> FeatureSpec:
    """Card features per loan.

    ``as_coded`` raises the utilization and debt flags on any single month;
    ``intended`` applies the same thresholds to the averages.
    """
    used = card_utilization()
    borrowed = diff("AMT_DRAWINGS_CURRENT", "AMT_PAYMENT_CURRENT")
    base = {
        "cc_avg_utilization": F.avg(used),
        "cc_any_high": any_flag((F.col("AMT_CREDIT_LIMIT_ACTUAL") > 0) & (used > HIGH_UTILIZATION)),
        "cc_recent_utilization": avg_where(used, F.col("MONTHS_BALANCE") == LAST_MONTH),
        "cc_avg_draw": F.avg("AMT_DRAWINGS_CURRENT"),
        "cc_avg_pay": F.avg("AMT_PAYMENT_CURRENT"),
        "has_cc_activity": any_flag(F.col("AMT_DRAWINGS_CURRENT") > 0),
        "cc_any_accruing": any_flag((borrowed > 0) & (borrowed < EXTREME_BORROWING)),
        "cc_avg_borrowed": F.avg(borrowed),
    }
    c = F.col
    if variant == "as_coded":
        high, accruing = c("cc_any_high"), c("cc_any_accruing")
        base.pop("cc_avg_borrowed")
    elif variant == "intended":
        high = flag(c("cc_avg_utilization") > HIGH_UTILIZATION)
        accruing = flag((c("cc_avg_borrowed") > 0) & (c("cc_avg_borrowed") < EXTREME_BORROWING))
    else:
        raise ValueError(f"unknown variant {variant!r}")
    derived = {
        "cc_avg_utilization": c("cc_avg_utilization"),
        "is_cc_high_utilization": high,
        "cc_recent_utilization": c("cc_recent_utilization"),
        "is_cc_low_pay_ratio": flag((c("cc_avg_draw") > 0)
                                    & (ratio("cc_avg_pay", "cc_avg_draw", None) < LOW_PAY_RATIO)),
        "has_cc_activity": c("has_cc_activity"),
        "is_cc_accruing_debt": accruing,
    }
    return FeatureSpec("card", base, derived)


def previous_parts(previous: DataFrame, pos: DataFrame, installments: DataFrame, card: DataFrame,
                   variant: str = "as_coded") -> list[tuple[FeatureSpec, DataFrame]]:
    """The four feature specs with the detail rows each reads."""
    return [
        (previous_spec(), keyed(previous, PREVIOUS_COLUMNS)),
        (pos_spec(), keyed(pos, POS_COLUMNS)),
        (installment_spec(), keyed(installments, INSTALLMENT_COLUMNS)),
        (card_spec(variant), keyed(card, CARD_COLUMNS)),
    ]


def previous_risk(previous: DataFrame) -> DataFrame:
    return previous_spec().table(keyed(previous, PREVIOUS_COLUMNS))


def pos_risk(pos: DataFrame) -> DataFrame:
    return pos_spec().table(keyed(pos, POS_COLUMNS))


def installment_risk(installments: DataFrame) -> DataFrame:
    return installment_spec().table(keyed(installments, INSTALLMENT_COLUMNS))


def card_risk(card: DataFrame, variant: str = "as_coded") -> DataFrame:
    return card_spec(variant).table(keyed(card, CARD_COLUMNS))


def previous_features(previous: DataFrame, pos: DataFrame, installments: DataFrame,
                      card: DataFrame, variant: str = "as_coded", form: str = "union") -> DataFrame:
    """All four feature groups by loan, with loans that occur in any of them.

    ``form='union'`` folds the aggregates in one pass; ``form='join'`` is the
    chain of full outer joins, whose coalesced key costs an exchange per step.
    """
    parts = previous_parts(previous, pos, installments, card, variant)
    if form == "union":
        return union_merge(parts, "loanId")
    return full_outer_merge([spec.table(detail) for spec, detail in parts], "loanId")


# ---- earlier generation, from cleaned tables --------------------------------
def previous_application_features(previous: DataFrame) -> DataFrame:
    status, kind = F.col("NAME_CONTRACT_STATUS"), F.col("NAME_CONTRACT_TYPE")
    approved = count_if(status == "Approved")
    return previous.groupBy("SK_ID_CURR").agg(
        F.count("SK_ID_PREV").alias("PREV_CNT"),
        approved.alias("PREV_APPROVED_CNT"),
        count_if(status == "Refused").alias("PREV_REFUSED_CNT"),
        ratio(approved, F.count("SK_ID_PREV")).alias("PREV_APPROVAL_RATE"),
        F.avg("AMT_CREDIT").alias("PREV_AVG_AMT_CREDIT"),
        F.sum("AMT_CREDIT").alias("PREV_TOTAL_AMT_CREDIT"),
        F.avg("AMT_DOWN_PAYMENT").alias("PREV_AVG_DOWN_PAYMENT"),
        F.avg("RATE_INTEREST_PRIMARY").alias("PREV_AVG_INTEREST"),
        count_if(kind.like("%Cash%")).alias("PREV_CASH_LOAN_CNT"),
        count_if(kind.like("%Revolving%")).alias("PREV_REVOLVING_CNT"),
        F.max("DAYS_DECISION").alias("PREV_DAYS_SINCE_LAST_APP"),
        F.sum("NFLAG_INSURED_ON_APPROVAL").alias("PREV_INSURED_CNT"),
    )


def pos_loan_features(pos: DataFrame) -> DataFrame:
    status = F.col("NAME_CONTRACT_STATUS")
    return pos.groupBy("SK_ID_CURR").agg(
        F.count_distinct("SK_ID_PREV").alias("POS_CNT"),
        F.avg("CNT_INSTALMENT_FUTURE").alias("POS_AVG_REMAINING_INST"),
        F.avg("SK_DPD").alias("POS_AVG_DPD"),
        F.max("SK_DPD").alias("POS_MAX_DPD"),
        count_if(status == "Active").alias("POS_ACTIVE_CNT"),
        count_if(status == "Completed").alias("POS_COMPLETED_CNT"),
        share(F.col("SK_DPD") > 0).alias("POS_OVERDUE_RATIO"),
    )


def installment_payment_features(installments: DataFrame) -> DataFrame:
    """In the cleaned table a missing payment day is day 0, so it counts as late."""
    late = F.col("DAYS_ENTRY_PAYMENT") > F.col("DAYS_INSTALMENT")
    paid = ratio("AMT_PAYMENT", "AMT_INSTALMENT", on_zero=None)
    return installments.groupBy("SK_ID_CURR").agg(
        F.count(F.lit(1)).alias("INSTAL_CNT"),
        F.avg(paid).alias("INSTAL_AVG_PAYMENT_RATIO"),
        F.stddev_samp(paid).alias("INSTAL_STD_PAYMENT_RATIO"),
        count_if(late).alias("INSTAL_LATE_CNT"),
        share(late).alias("INSTAL_LATE_RATIO"),
        avg_where(diff("DAYS_ENTRY_PAYMENT", "DAYS_INSTALMENT"), late, els=0.0)
        .alias("INSTAL_AVG_DAYS_LATE"),
        F.sum("AMT_PAYMENT").alias("INSTAL_TOTAL_PAYMENT"),
    )


def credit_card_features(card: DataFrame) -> DataFrame:
    used = card_utilization()
    return card.groupBy("SK_ID_CURR").agg(
        F.count_distinct("SK_ID_PREV").alias("CC_CNT"),
        F.avg("AMT_BALANCE").alias("CC_AVG_BALANCE"),
        F.sum("AMT_CREDIT_LIMIT_ACTUAL").alias("CC_TOTAL_LIMIT"),
        F.avg(used).alias("CC_AVG_UTILIZATION"),
        F.max(used).alias("CC_MAX_UTILIZATION"),
        F.avg("AMT_PAYMENT_TOTAL_CURRENT").alias("CC_AVG_PAYMENT"),
        F.avg("AMT_DRAWINGS_ATM_CURRENT").alias("CC_AVG_ATM_DRAWINGS"),
        share(F.col("AMT_BALANCE") > F.col("AMT_CREDIT_LIMIT_ACTUAL")).alias("CC_OVERLIMIT_RATIO"),
        F.avg("SK_DPD").alias("CC_AVG_DPD"),
        F.max("SK_DPD").alias("CC_MAX_DPD"),
    )
