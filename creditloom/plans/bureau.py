"""Credit-bureau features.

A loan's bureau records join its monthly balance rows one-to-many. The
balances are reduced to one row per bureau record first; each record then
carries ``weight``, the number of joined rows it stands for, so totals over
the fan-out come out unchanged while only two small exchanges remain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.functions import (
    all_flag, any_flag, code_to_int, count_if, flag, ratio, weighted_avg,
)
from creditloom.operators.features import FeatureSpec
from creditloom.operators.joins import join_summary
from creditloom.operators.projection import rename_project

# ---- fixed values -----------------------------------------------------------
DELINQUENT_CODES = ["1", "2", "3", "4", "5"]
WORST_CODE = "5"
RECENT_MONTHS = -3
RECENT_DAYS = -30
HIGH_UTILIZATION = 0.7
COLLATERAL_TYPES = ["Car loan", "Mortgage"]
BUREAU_NAMES = {
    "SK_ID_CURR": "loanId", "SK_ID_BUREAU": "bureauId", "CREDIT_ACTIVE": "creditActive",
    "CREDIT_CURRENCY": "creditCurrency", "DAYS_CREDIT": "daysCredit",
    "CREDIT_DAY_OVERDUE": "overdueDays", "DAYS_CREDIT_ENDDATE": "creditEndDays",
    "DAYS_ENDDATE_FACT": "enddateFact", "AMT_CREDIT_MAX_OVERDUE": "maxOverdue",
    "CNT_CREDIT_PROLONG": "prolongCount", "AMT_CREDIT_SUM": "creditSum",
    "AMT_CREDIT_SUM_DEBT": "debtSum", "AMT_CREDIT_SUM_LIMIT": "creditLimit",
    "AMT_CREDIT_SUM_OVERDUE": "overdueSum", "CREDIT_TYPE": "creditType",
    "DAYS_CREDIT_UPDATE": "daysCreditUpdate", "AMT_ANNUITY": "annuityAmt",
}
BALANCE_NAMES = {"SK_ID_BUREAU": "bureauId", "MONTHS_BALANCE": "monthsBalance", "STATUS": "status"}


def balance_aggregates() -> list[Column]:
    """Everything later steps need of a record's balance history, as sums and extremes."""
    status, month = F.col("status"), F.col("monthsBalance")
    code = code_to_int(status, DELINQUENT_CODES)
    recent = month >= RECENT_MONTHS
    return [
        F.count(F.lit(1)).alias("months"),
        count_if(status.isin(DELINQUENT_CODES)).alias("delinquent"),
        F.max(code).alias("maxCode"),
        any_flag(status == WORST_CODE).alias("worst"),
        F.sum(code).alias("codeSum"),
        F.sum(F.when(recent, code)).alias("recentCodeSum"),
        count_if(recent).alias("recentMonths"),
        F.min(month).alias("firstMonth"),
        F.max(month).alias("lastMonth"),
    ]


def bureau_with_history(bureau: DataFrame, balance: DataFrame) -> DataFrame:
    """Bureau records with their balance summary and fan-out ``weight``."""
    joined = join_summary(rename_project(bureau, BUREAU_NAMES),
                          rename_project(balance, BALANCE_NAMES), "bureauId", balance_aggregates())
    return joined.withColumn("weight", F.coalesce("months", F.lit(1)))


def _loan_status(status: str) -> Column:
    return flag(F.col("creditActive") == status)


def utilization() -> Column:
    """Debt over limit where the record has a limit."""
    return F.when(F.col("creditLimit") > 0, F.try_divide("debtSum", "creditLimit"))


def _shared_base() -> dict[str, Column]:
    return {
        "has_sold": any_flag(F.col("creditActive") == "Sold"),
        "has_active": any_flag(F.col("creditActive") == "Active"),
        "has_credit_limit": any_flag(F.col("creditLimit") > 0),
        "ever_overdue": any_flag(F.col("maxOverdue") > 0),
        "is_recent_update": any_flag(F.col("daysCreditUpdate") >= RECENT_DAYS),
        "is_microloan": any_flag(F.col("creditType") == "Microloan"),
        "has_credit_card": any_flag(F.col("creditType") == "Credit card"),
        "has_collateral_loan": any_flag(F.col("creditType").isin(COLLATERAL_TYPES)),
        "delinquent_months": F.sum(F.coalesce("delinquent", F.lit(0))),
        "max_status": F.max(F.coalesce("maxCode", F.lit(0))),
        "ever_status_5": F.max(F.coalesce("worst", F.lit(0))),
        "history_length": F.max("lastMonth") - F.min("firstMonth"),
        "only_closed": all_flag(F.col("creditActive") == "Closed"),
    }


def bureau_spec(variant: str = "as_coded") -> FeatureSpec:
    """Bureau features per loan: 20 columns next to the key.

    ``as_coded`` reproduces the production definition, where counts, sums and
    averages run over joined balance rows. ``intended`` follows the written
    analysis: each record counts once, utilization is averaged over records
    that have a limit, the recent status is averaged over recent months only,
    and ``all_closed`` means every record is closed.
    """
    base = _shared_base()
    if variant == "as_coded":
        w = F.col("weight")
        base |= {
            "active_bureau_loans": F.sum(_loan_status("Active") * w),
            "closed_bureau_loans": F.sum(_loan_status("Closed") * w),
            "sold_bureau_loans": F.sum(_loan_status("Sold") * w),
            "overdueSum": F.sum(F.col("overdueSum") * w),
            "utilization": weighted_avg(
                F.when(F.col("creditLimit") > 0, utilization()).otherwise(0.0), w),
            "recentStatus": ratio(F.sum(F.coalesce("recentCodeSum", F.lit(0))), F.sum(w)),
            "overallStatus": ratio(F.sum(F.coalesce("codeSum", F.lit(0))), F.sum(w)),
        }
        all_closed = flag((F.col("sold_bureau_loans") == 0) & (F.col("active_bureau_loans") == 0))
    elif variant == "intended":
        base |= {
            "active_bureau_loans": F.sum(_loan_status("Active")),
            "closed_bureau_loans": F.sum(_loan_status("Closed")),
            "sold_bureau_loans": F.sum(_loan_status("Sold")),
            "overdueSum": F.sum("overdueSum"),
            "utilization": F.avg(utilization()),
            "recentStatus": ratio(F.sum("recentCodeSum"), F.sum("recentMonths"), on_zero=None),
            "overallStatus": ratio(F.sum("codeSum"), F.sum("months"), on_zero=None),
        }
        all_closed = F.col("only_closed")
    else:
        raise ValueError(f"unknown variant {variant!r}")
    c = F.col
    derived = {
        "has_sold": c("has_sold"),
        "has_active": c("has_active"),
        "all_closed": all_closed,
        "active_loan_count": c("active_bureau_loans"),
        "overdueSum": c("overdueSum"),
        "is_high_utilization": flag(c("utilization") > HIGH_UTILIZATION),
        "has_credit_limit": c("has_credit_limit"),
        "ever_overdue": c("ever_overdue"),
        "is_recent_update": c("is_recent_update"),
        "is_microloan": c("is_microloan"),
        "has_credit_card": c("has_credit_card"),
        "has_collateral_loan": c("has_collateral_loan"),
        "delinquent_months": c("delinquent_months"),
        "ever_delinquent": flag(c("max_status") > 0),
        "ever_status_5": c("ever_status_5"),
        "is_worsening_trend": flag(c("recentStatus") > c("overallStatus")),
        "history_length": c("history_length"),
        "active_bureau_loans": c("active_bureau_loans"),
        "closed_bureau_loans": c("closed_bureau_loans"),
        "sold_bureau_loans": c("sold_bureau_loans"),
    }
    return FeatureSpec("bureau", base, derived)


def bureau_features(bureau: DataFrame, balance: DataFrame, variant: str = "as_coded") -> DataFrame:
    return bureau_spec(variant).table(bureau_with_history(bureau, balance))


# ---- earlier generation, from cleaned tables --------------------------------
def bureau_credit_features(bureau: DataFrame) -> DataFrame:
    """Credit volume per customer from cleaned bureau records."""
    total, debt = F.sum("AMT_CREDIT_SUM"), F.sum("AMT_CREDIT_SUM_DEBT")
    return bureau.groupBy("SK_ID_CURR").agg(
        F.count("SK_ID_BUREAU").alias("BUREAU_CNT"),
        count_if(F.col("CREDIT_ACTIVE") == "Active").alias("BUREAU_ACTIVE_CNT"),
        count_if(F.col("CREDIT_ACTIVE") == "Closed").alias("BUREAU_CLOSED_CNT"),
        F.avg(F.abs("DAYS_CREDIT") / F.lit(365.25)).alias("BUREAU_AVG_CREDIT_DURATION"),
        F.max("AMT_CREDIT_MAX_OVERDUE").alias("BUREAU_MAX_OVERDUE"),
        F.avg("AMT_CREDIT_MAX_OVERDUE").alias("BUREAU_AVG_OVERDUE"),
        total.alias("BUREAU_TOTAL_CREDIT_SUM"),
        debt.alias("BUREAU_TOTAL_DEBT"),
        F.when(total > 0, debt / total).otherwise(0.0).alias("BUREAU_DEBT_CREDIT_RATIO"),
        F.avg("AMT_ANNUITY").alias("BUREAU_AVG_ANNUITY"),
        F.sum("CNT_CREDIT_PROLONG").alias("BUREAU_TOTAL_PROLONG"),
        F.max("DAYS_CREDIT_UPDATE").alias("BUREAU_DAYS_SINCE_LAST_UPDATE"),
    )


def bureau_delinquency_features(bureau: DataFrame, balance: DataFrame) -> DataFrame:
    """Status history per customer from cleaned records; C and X count as 0."""
    status, month = F.col("STATUS"), F.col("MONTHS_BALANCE")
    code = F.when(status.isin("C", "X"), 0).otherwise(code_to_int(status))
    per_record = balance.groupBy("SK_ID_BUREAU").agg(
        F.sum(code).alias("codeSum"), F.count(code).alias("codes"), F.max(code).alias("maxCode"),
        count_if(code >= 1).alias("overdue"), F.count(month).alias("months"),
        F.min(month).alias("firstMonth"), F.max(month).alias("lastMonth"))
    joined = bureau.select("SK_ID_CURR", "SK_ID_BUREAU").join(per_record, "SK_ID_BUREAU", "inner")
    return joined.groupBy("SK_ID_CURR").agg(
        ratio(F.sum("codeSum"), F.sum("codes"), on_zero=None).alias("BB_AVG_STATUS"),
        F.max("maxCode").alias("BB_MAX_STATUS"),
        F.sum("overdue").alias("BB_OVERDUE_MONTHS"),
        ratio(F.sum("overdue"), F.sum("months")).alias("BB_OVERDUE_RATIO"),
        (F.max("lastMonth") - F.min("firstMonth")).alias("BB_HISTORY_LENGTH"),
    )
