"""Raw loan tables derived from the driver tables, row for row.

customer stands for applications, orders for bureau records and earlier
applications, lineitem for monthly balances and instalments, events for POS
and card snapshots. ``workload.oracle`` states the same mapping in SQL.
Amounts carry a factor of pi (bureau limits do not), so that no average of them
sits on a rounding edge and no average utilization on a threshold, where the
order of a floating-point sum would decide.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.plans.application import application_view

REFERENCE_DAY = "DATE '2001-12-01'"
REFERENCE_MONTH = 2001 * 12 + 11    # the latest month that ships


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").selectExpr(
        "*", "CAST(ROUND(ABS(c_acctbal) * 100) AS BIGINT) AS cents",
        "CAST(c_nationkey AS INT) AS nk", "45000 + 20 * PI() * ABS(c_acctbal) AS credit")
    return c.selectExpr(
        "c_custkey AS SK_ID_CURR",
        "CAST(IF(c_acctbal < 0, 1, 0) AS INT) AS TARGET",
        "CASE WHEN nk = 7 THEN NULL WHEN c_acctbal BETWEEN 0 AND 1000 THEN 'Revolving loans'"
        " ELSE 'Cash loans' END AS NAME_CONTRACT_TYPE",
        "IF(nk % 2 = 0, 'F', 'M') AS CODE_GENDER",
        "CASE WHEN cents % 3 = 0 THEN 'Y' WHEN cents % 3 = 1 OR nk > 2 THEN 'N' END AS FLAG_OWN_CAR",
        "IF(cents % 2 = 0, 'Y', 'N') AS FLAG_OWN_REALTY",
        "nk % 4 AS CNT_CHILDREN",
        "CAST(NULLIF(nk % 6, 5) AS DOUBLE) AS CNT_FAM_MEMBERS",
        "IF(c_mktsegment = 'BUILDING' AND nk = 0, 0D, 20000 + 5 * PI() * ABS(c_acctbal)) AS AMT_INCOME_TOTAL",
        "credit AS AMT_CREDIT",
        "IF(nk = 11, NULL, credit / (12 + nk)) AS AMT_ANNUITY",
        "CASE c_mktsegment WHEN 'HOUSEHOLD' THEN credit WHEN 'MACHINERY' THEN credit * 1.25D"
        " WHEN 'FURNITURE' THEN credit * 0.75D WHEN 'AUTOMOBILE' THEN credit - 1000 + nk * 100"
        " END AS AMT_GOODS_PRICE",
        "CAST(-(7000 + cents % 17000) AS INT) AS DAYS_BIRTH",
        "CAST(CASE WHEN nk % 5 = 0 THEN 365243 WHEN nk = 13 THEN NULL ELSE -(cents % 9000) END AS INT)"
        " AS DAYS_EMPLOYED",
        "CAST(-(cents % 7301) AS DOUBLE) AS DAYS_REGISTRATION",
        "CAST(-(cents * 7 % 6001) AS INT) AS DAYS_ID_PUBLISH",
        "CAST(IF(nk = 19, NULL, -(cents % 3001)) AS INT) AS DAYS_LAST_PHONE_CHANGE",
        "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Working' WHEN 'BUILDING' THEN 'State servant'"
        " WHEN 'FURNITURE' THEN 'Pensioner' WHEN 'HOUSEHOLD' THEN 'Commercial associate'"
        " ELSE 'Businessman' END AS NAME_INCOME_TYPE",
        "CASE nk % 7 WHEN 3 THEN 'Drivers' WHEN 4 THEN 'Sales staff' WHEN 5 THEN 'Managers'"
        " WHEN 6 THEN 'Laborers' END AS OCCUPATION_TYPE",
        "CASE nk % 5 WHEN 0 THEN 'Family' WHEN 1 THEN 'Unaccompanied' WHEN 2 THEN 'Children'"
        " WHEN 3 THEN 'Other_A' END AS NAME_TYPE_SUITE",
        "IF(cents % 5 = 0, 1, 0) AS REG_REGION_NOT_LIVE_REGION",
        "IF(cents % 4 = 0, 1, 0) AS REG_CITY_NOT_LIVE_CITY",
        "IF(cents % 7 = 0, 1, 0) AS LIVE_REGION_NOT_WORK_REGION",
        "IF(cents % 3 = 1, 1, 0) AS LIVE_CITY_NOT_WORK_CITY",
        "1 + nk % 3 AS REGION_RATING_CLIENT",
        "CASE cents % 7 WHEN 0 THEN 'MONDAY' WHEN 1 THEN 'TUESDAY' WHEN 2 THEN 'WEDNESDAY'"
        " WHEN 3 THEN 'THURSDAY' WHEN 4 THEN 'FRIDAY' WHEN 5 THEN 'SATURDAY' ELSE 'SUNDAY' END"
        " AS WEEKDAY_APPR_PROCESS_START",
        "CAST(cents % 24 AS INT) AS HOUR_APPR_PROCESS_START",
        "IF(nk < 8, NULL, PI() * ABS(c_acctbal) / 40000) AS EXT_SOURCE_1",
        "nk / 25D AS EXT_SOURCE_2",
        "IF(c_mktsegment = 'BUILDING', NULL, cents % 1000 / 1000D) AS EXT_SOURCE_3",
        "1 AS FLAG_MOBIL",
        "CAST(cents % 2 AS INT) AS FLAG_EMP_PHONE",
        "IF(cents % 3 = 0, 1, 0) AS FLAG_WORK_PHONE",
        "1 AS FLAG_CONT_MOBILE",
        "nk % 2 AS FLAG_PHONE",
        "IF(cents % 11 = 0, 1, 0) AS FLAG_EMAIL",
        "nk >= 20 AS unlabelled",
    )


def application_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return applications(spark, sf_dir).where(~F.col("unlabelled")).drop("unlabelled")


def application_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return applications(spark, sf_dir).where(F.col("unlabelled")).drop("unlabelled", "TARGET")


def labelled_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both splits in one frame, told apart by ``unlabelled``."""
    return applications(spark, sf_dir).withColumn("TARGET", F.when(~F.col("unlabelled"), F.col("TARGET")))


def application(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All applications with their label."""
    return applications(spark, sf_dir).drop("unlabelled")


def view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return application_view(application(spark, sf_dir), partial=True)


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "*", f"DATEDIFF(CAST(o_orderdate AS DATE), {REFERENCE_DAY}) AS days",
        "DAY(o_orderdate) AS dom", "o_totalprice * PI() AS amount")


def bureau(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).selectExpr(
        "o_custkey AS SK_ID_CURR", "o_orderkey AS SK_ID_BUREAU",
        "CASE WHEN o_orderstatus = 'F' THEN 'Closed' WHEN o_orderstatus = 'O' THEN 'Active'"
        " WHEN o_totalprice < 10000 THEN 'Bad debt' ELSE 'Sold' END AS CREDIT_ACTIVE",
        "'currency 1' AS CREDIT_CURRENCY",
        "days AS DAYS_CREDIT",
        "IF(o_orderstatus = 'O' AND o_orderpriority = '1-URGENT', dom, 0) AS CREDIT_DAY_OVERDUE",
        "CAST(days + 365 AS DOUBLE) AS DAYS_CREDIT_ENDDATE",
        "CAST(IF(o_orderstatus = 'F', days + 300, NULL) AS DOUBLE) AS DAYS_ENDDATE_FACT",
        "CASE o_orderpriority WHEN '1-URGENT' THEN amount * 0.01D WHEN '2-HIGH' THEN 0D END"
        " AS AMT_CREDIT_MAX_OVERDUE",
        "MONTH(o_orderdate) % 3 AS CNT_CREDIT_PROLONG",
        "IF(dom = 31, NULL, amount) AS AMT_CREDIT_SUM",
        "CASE WHEN dom = 30 THEN NULL WHEN o_orderstatus = 'O' THEN amount * 0.9D"
        " WHEN o_orderstatus = 'P' THEN amount * 0.5D ELSE 0D END AS AMT_CREDIT_SUM_DEBT",
        "CASE o_orderpriority WHEN '5-LOW' THEN NULL WHEN '4-NOT SPECIFIED' THEN 0D"
        " ELSE o_totalprice * dom / 5D END AS AMT_CREDIT_SUM_LIMIT",
        "IF(o_orderpriority = '1-URGENT', amount * 0.05D, 0D) AS AMT_CREDIT_SUM_OVERDUE",
        "CASE WHEN o_orderpriority = '1-URGENT' AND o_totalprice < 100000 THEN 'Microloan'"
        " WHEN o_orderpriority = '2-HIGH' THEN 'Credit card'"
        " WHEN o_orderpriority = '3-MEDIUM' AND o_totalprice > 400000 THEN 'Mortgage'"
        " WHEN o_orderpriority = '3-MEDIUM' AND o_totalprice > 300000 THEN 'Car loan'"
        " WHEN o_orderpriority = '5-LOW' AND dom = 1 THEN NULL ELSE 'Consumer credit' END"
        " AS CREDIT_TYPE",
        "days + 115 AS DAYS_CREDIT_UPDATE",
        "IF(o_orderstatus = 'F', NULL, amount / 12) AS AMT_ANNUITY",
    )


def bureau_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS SK_ID_BUREAU",
        # Most records are young, so that some loans have short histories only.
        f"CASE WHEN l_orderkey % 5 = 4 THEN YEAR(l_shipdate) * 12 + MONTH(l_shipdate) - {REFERENCE_MONTH}"
        " ELSE -((MONTH(l_shipdate) + l_linenumber) % (5 + 7 * CAST(l_orderkey % 2 AS INT))) END AS MONTHS_BALANCE",
        "CASE WHEN l_quantity = 50 THEN NULL"
        " WHEN l_returnflag = 'R' THEN CAST(1 + (l_linenumber - 1) % 5 AS STRING)"
        " WHEN l_returnflag = 'A' THEN '0' WHEN l_linestatus = 'O' THEN 'C' ELSE 'X' END AS STATUS",
    )


# Columns of earlier applications that no feature uses; the same text is SQL for either engine.
PREVIOUS_REST = {
    "AMT_APPLICATION": "CASE WHEN dom <> 2 THEN amount * 0.95e0 END",
    "AMT_GOODS_PRICE": "CASE WHEN o_orderpriority <> '5-LOW' THEN amount * 0.9e0 END",
    "WEEKDAY_APPR_PROCESS_START": "CASE dom % 7 WHEN 0 THEN 'MONDAY' WHEN 1 THEN 'TUESDAY' WHEN 2 THEN 'WEDNESDAY'"
                                  " WHEN 3 THEN 'THURSDAY' WHEN 4 THEN 'FRIDAY' WHEN 5 THEN 'SATURDAY' END",
    "HOUR_APPR_PROCESS_START": "CASE WHEN dom <> 24 THEN CAST(dom % 24 AS INT) END",
    "FLAG_LAST_APPL_PER_CONTRACT": "CASE dom % 3 WHEN 0 THEN 'Y' WHEN 1 THEN 'N' END",
    "NFLAG_LAST_APPL_IN_DAY": "CASE WHEN dom <> 5 THEN CAST(dom % 2 AS INT) END",
    "RATE_DOWN_PAYMENT": "CASE WHEN o_orderstatus = 'F' THEN dom / 310e0 END",
    "RATE_INTEREST_PRIVILEGED": "CASE WHEN dom = 7 THEN 0.8e0 END",
    "NAME_CASH_LOAN_PURPOSE": "CASE WHEN o_orderpriority = '1-URGENT' THEN 'Repairs' WHEN o_orderpriority = '2-HIGH' THEN 'Car' END",
    "NAME_PAYMENT_TYPE": "CASE WHEN dom < 29 THEN 'Cash through the bank' END",
    "NAME_TYPE_SUITE": "CASE dom % 4 WHEN 0 THEN 'Family' WHEN 1 THEN 'Unaccompanied' WHEN 2 THEN 'Children' END",
    "NAME_CLIENT_TYPE": "CASE WHEN o_orderstatus = 'F' THEN 'Repeater' WHEN o_orderstatus = 'O' THEN 'New' END",
    "NAME_GOODS_CATEGORY": "CASE dom % 5 WHEN 0 THEN 'Mobile' WHEN 1 THEN 'Furniture' WHEN 2 THEN 'Computers' END",
    "NAME_PORTFOLIO": "CASE WHEN o_orderpriority = '3-MEDIUM' THEN 'Cards' WHEN dom < 20 THEN 'POS' END",
    "NAME_PRODUCT_TYPE": "CASE WHEN o_orderpriority = '2-HIGH' THEN 'x-sell' WHEN dom > 3 THEN 'walk-in' END",
    "CHANNEL_TYPE": "CASE WHEN dom % 2 = 0 THEN 'Stone' WHEN dom % 3 = 0 THEN 'Contact center' END",
    "SELLERPLACE_AREA": "CASE WHEN dom <> 11 THEN CAST(dom * 100 - 1 AS INT) END",
    "NAME_SELLER_INDUSTRY": "CASE dom % 6 WHEN 0 THEN 'Connectivity' WHEN 1 THEN 'Furniture' END",
    "CNT_PAYMENT": "CASE WHEN dom < 25 THEN dom * 2e0 END",
    "NAME_YIELD_GROUP": "CASE WHEN dom < 10 THEN 'low_normal' WHEN dom < 20 THEN 'high' END",
    "PRODUCT_COMBINATION": "CASE WHEN o_orderpriority = '3-MEDIUM' THEN 'Card Street' WHEN dom < 27 THEN 'Cash' END",
    "DAYS_FIRST_DRAWING": "CASE WHEN dom = 1 THEN 365243e0 WHEN dom = 2 THEN days + 1e0 END",
    "DAYS_FIRST_DUE": "CASE WHEN o_orderstatus = 'F' THEN days + 30e0 END",
    "DAYS_LAST_DUE_1ST_VERSION": "CASE WHEN o_orderstatus = 'F' THEN days + 390e0 END",
    "DAYS_LAST_DUE": "CASE WHEN o_orderstatus = 'F' AND dom <> 9 THEN days + 360e0 END",
    "DAYS_TERMINATION": "CASE WHEN o_orderstatus = 'F' AND dom <> 9 THEN days + 365e0 END",
}


def previous_application(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).selectExpr(
        *(f"{expr} AS {name}" for name, expr in PREVIOUS_REST.items()),
        "o_orderkey AS SK_ID_PREV", "o_custkey AS SK_ID_CURR",
        "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Cash loans'"
        " WHEN o_orderpriority = '3-MEDIUM' THEN 'Revolving loans' ELSE 'Consumer loans' END"
        " AS NAME_CONTRACT_TYPE",
        "amount / 24 AS AMT_ANNUITY",
        "amount AS AMT_CREDIT",
        "IF(o_orderstatus = 'O', NULL, amount * 0.1D) AS AMT_DOWN_PAYMENT",
        "IF(o_orderstatus = 'F', PI() * dom / 300D, NULL) AS RATE_INTEREST_PRIMARY",
        "CASE o_orderstatus WHEN 'F' THEN 'Approved' WHEN 'O' THEN 'Refused' ELSE 'Canceled' END"
        " AS NAME_CONTRACT_STATUS",
        "days + 115 AS DAYS_DECISION",
        "CASE WHEN o_orderpriority = '5-LOW' THEN NULL WHEN o_orderstatus <> 'O' THEN 'XAP'"
        " WHEN o_orderpriority = '1-URGENT' AND dom < 8 THEN 'SCOFR'"
        " WHEN o_orderpriority = '2-HIGH' AND dom > 20 THEN 'LIMIT' ELSE 'HC' END AS CODE_REJECT_REASON",
        "CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_orderpriority = '3-MEDIUM' THEN 1D ELSE 0D END"
        " AS NFLAG_INSURED_ON_APPROVAL",
    )


def installments_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instalments are order lines; the order supplies the loan and the due day."""
    orders = _orders(spark, sf_dir).select("o_orderkey", "o_custkey", "days")
    lines = table(spark, sf_dir, "lineitem")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).selectExpr(
        "l_orderkey AS SK_ID_PREV", "o_custkey AS SK_ID_CURR",
        "CASE o_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 0D WHEN 2 THEN 2D"
        " ELSE IF(l_linenumber = 7, 0D, 1D) END AS NUM_INSTALMENT_VERSION",
        "l_linenumber AS NUM_INSTALMENT_NUMBER",
        "CAST(days AS DOUBLE) AS DAYS_INSTALMENT",
        "CAST(IF(l_tax = 0, NULL, days + DAY(l_shipdate) - 8) AS DOUBLE) AS DAYS_ENTRY_PAYMENT",
        "IF(l_discount = 0, 0D, l_extendedprice * PI()) AS AMT_INSTALMENT",
        "CASE WHEN l_quantity = 1 THEN NULL"
        " WHEN l_returnflag = 'R' AND l_discount > 0.065D THEN l_extendedprice * PI() * 0.5D"
        " ELSE l_extendedprice * PI() END AS AMT_PAYMENT",
    )


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events of ten hours are ten loans."""
    return table(spark, sf_dir, "events").selectExpr("*", "user_id * 10 + HOUR(ts) % 10 AS loan")


def pos_cash_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).selectExpr(
        "loan * 100 + HOUR(ts) AS SK_ID_PREV", "loan AS SK_ID_CURR",
        "CAST(-(FLOOR(value / 4) % 97) AS INT) AS MONTHS_BALANCE",
        "CAST(DAY(ts) AS DOUBLE) AS CNT_INSTALMENT",
        "CAST(NULLIF(HOUR(ts), 0) AS DOUBLE) AS CNT_INSTALMENT_FUTURE",
        "CASE WHEN event_type IN ('view', 'click') THEN 'Active'"
        " WHEN event_type = 'purchase' THEN 'Completed' ELSE 'Signed' END AS NAME_CONTRACT_STATUS",
        "IF(event_type = 'error', DAY(ts), 0) AS SK_DPD",
        "0 AS SK_DPD_DEF",
    )


def credit_card_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).selectExpr(
        "loan * 100 + DAY(ts) AS SK_ID_PREV", "loan AS SK_ID_CURR",
        "-DAY(ts) AS MONTHS_BALANCE",
        "PI() * value * CASE loan % 4 WHEN 0 THEN 10D WHEN 1 THEN 5D WHEN 2 THEN 2D ELSE 0.5D END AS AMT_BALANCE",
        "CAST(CASE event_type WHEN 'signup' THEN 0 WHEN 'error' THEN NULL"
        " ELSE 100 * (HOUR(ts) + 1) END AS INT) AS AMT_CREDIT_LIMIT_ACTUAL",
        "IF(event_type = 'click', PI() * value * 2, NULL) AS AMT_DRAWINGS_ATM_CURRENT",
        "CASE WHEN loan % 11 = 3 THEN 0D WHEN loan % 13 = 5 THEN PI() * value * 5000"
        " WHEN event_type = 'purchase' THEN PI() * value * 20 WHEN event_type = 'view' THEN 0D"
        " WHEN event_type = 'click' THEN NULL ELSE PI() * value END AS AMT_DRAWINGS_CURRENT",
        "IF(loan % 7 = 2, NULL, PI() * value * (loan % 5) * 2.5D) AS AMT_PAYMENT_CURRENT",
        "PI() * value * 1.5D AS AMT_PAYMENT_TOTAL_CURRENT",
        "'Active' AS NAME_CONTRACT_STATUS",
        "DAY(ts) % 5 AS SK_DPD", "0 AS SK_DPD_DEF",
    )


HISTORY: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "bureau": bureau,
    "bureau_balance": bureau_balance,
    "previous_application": previous_application,
    "POS_CASH_balance": pos_cash_balance,
    "installments_payments": installments_payments,
    "credit_card_balance": credit_card_balance,
}


def raw(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The six history tables by their raw name."""
    return {name: make(spark, sf_dir) for name, make in HISTORY.items()}
