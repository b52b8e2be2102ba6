"""SQL twins of the registered queries, for DuckDB over the driver tables.

Each text is self-contained: the role mapping comes first as CTEs, then the
query is stated the direct way - fan-out joins are joined out, medians and
modes are plain aggregates - so it checks the rewrites on the Spark side.
"""

from __future__ import annotations

from workload.queries import NUMERIC, STRINGS
from workload.roles import PREVIOUS_REST

# ---- role mapping -----------------------------------------------------------
ROLE_SQL = {
    "app_all": """
        SELECT c_custkey AS "SK_ID_CURR", (c_acctbal < 0)::INT AS "TARGET",
          CASE WHEN nk = 7 THEN NULL WHEN c_acctbal BETWEEN 0 AND 1000 THEN 'Revolving loans'
               ELSE 'Cash loans' END AS "NAME_CONTRACT_TYPE",
          CASE WHEN nk % 2 = 0 THEN 'F' ELSE 'M' END AS "CODE_GENDER",
          CASE WHEN cents % 3 = 0 THEN 'Y' WHEN cents % 3 = 1 OR nk > 2 THEN 'N' END AS "FLAG_OWN_CAR",
          CASE WHEN cents % 2 = 0 THEN 'Y' ELSE 'N' END AS "FLAG_OWN_REALTY",
          (nk % 4)::INT AS "CNT_CHILDREN", nullif(nk % 6, 5)::DOUBLE AS "CNT_FAM_MEMBERS",
          CASE WHEN c_mktsegment = 'BUILDING' AND nk = 0 THEN 0e0
               ELSE 20000 + 5 * pi() * abs(c_acctbal) END AS "AMT_INCOME_TOTAL",
          credit AS "AMT_CREDIT",
          CASE WHEN nk = 11 THEN NULL ELSE credit / (12 + nk) END AS "AMT_ANNUITY",
          CASE c_mktsegment WHEN 'HOUSEHOLD' THEN credit WHEN 'MACHINERY' THEN credit * 1.25e0
               WHEN 'FURNITURE' THEN credit * 0.75e0
               WHEN 'AUTOMOBILE' THEN credit - 1000 + nk * 100 END AS "AMT_GOODS_PRICE",
          (-(7000 + cents % 17000))::INT AS "DAYS_BIRTH",
          (CASE WHEN nk % 5 = 0 THEN 365243 WHEN nk = 13 THEN NULL ELSE -(cents % 9000) END)::INT
            AS "DAYS_EMPLOYED",
          (-(cents % 7301))::DOUBLE AS "DAYS_REGISTRATION",
          (-(cents * 7 % 6001))::INT AS "DAYS_ID_PUBLISH",
          (CASE WHEN nk = 19 THEN NULL ELSE -(cents % 3001) END)::INT AS "DAYS_LAST_PHONE_CHANGE",
          CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Working' WHEN 'BUILDING' THEN 'State servant'
               WHEN 'FURNITURE' THEN 'Pensioner' WHEN 'HOUSEHOLD' THEN 'Commercial associate'
               ELSE 'Businessman' END AS "NAME_INCOME_TYPE",
          CASE nk % 7 WHEN 3 THEN 'Drivers' WHEN 4 THEN 'Sales staff' WHEN 5 THEN 'Managers'
               WHEN 6 THEN 'Laborers' END AS "OCCUPATION_TYPE",
          CASE nk % 5 WHEN 0 THEN 'Family' WHEN 1 THEN 'Unaccompanied' WHEN 2 THEN 'Children'
               WHEN 3 THEN 'Other_A' END AS "NAME_TYPE_SUITE",
          (cents % 5 = 0)::INT AS "REG_REGION_NOT_LIVE_REGION",
          (cents % 4 = 0)::INT AS "REG_CITY_NOT_LIVE_CITY",
          (cents % 7 = 0)::INT AS "LIVE_REGION_NOT_WORK_REGION",
          (cents % 3 = 1)::INT AS "LIVE_CITY_NOT_WORK_CITY",
          (1 + nk % 3)::INT AS "REGION_RATING_CLIENT",
          CASE cents % 7 WHEN 0 THEN 'MONDAY' WHEN 1 THEN 'TUESDAY' WHEN 2 THEN 'WEDNESDAY'
               WHEN 3 THEN 'THURSDAY' WHEN 4 THEN 'FRIDAY' WHEN 5 THEN 'SATURDAY' ELSE 'SUNDAY' END
            AS "WEEKDAY_APPR_PROCESS_START",
          (cents % 24)::INT AS "HOUR_APPR_PROCESS_START",
          CASE WHEN nk < 8 THEN NULL ELSE pi() * abs(c_acctbal) / 40000 END AS "EXT_SOURCE_1",
          nk / 25e0 AS "EXT_SOURCE_2",
          CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE (cents % 1000) / 1000e0 END AS "EXT_SOURCE_3",
          1 AS "FLAG_MOBIL", (cents % 2)::INT AS "FLAG_EMP_PHONE", (cents % 3 = 0)::INT AS "FLAG_WORK_PHONE",
          1 AS "FLAG_CONT_MOBILE", (nk % 2)::INT AS "FLAG_PHONE", (cents % 11 = 0)::INT AS "FLAG_EMAIL",
          nk >= 20 AS unlabelled
        FROM (SELECT *, round(abs(c_acctbal) * 100)::BIGINT AS cents, c_nationkey::INT AS nk,
                     45000 + 20 * pi() * abs(c_acctbal) AS credit FROM customer)""",
    "app": "SELECT * EXCLUDE (unlabelled) FROM app_all",
    "dated_orders": """
        SELECT *, date_diff('day', DATE '2001-12-01', o_orderdate::DATE)::INT AS days,
               day(o_orderdate)::INT AS dom, o_totalprice * pi() AS amount FROM orders""",
    "bureau": """
        SELECT o_custkey AS "SK_ID_CURR", o_orderkey AS "SK_ID_BUREAU",
          CASE WHEN o_orderstatus = 'F' THEN 'Closed' WHEN o_orderstatus = 'O' THEN 'Active'
               WHEN o_totalprice < 10000 THEN 'Bad debt' ELSE 'Sold' END AS "CREDIT_ACTIVE",
          'currency 1' AS "CREDIT_CURRENCY", days AS "DAYS_CREDIT",
          CASE WHEN o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' THEN dom ELSE 0 END
            AS "CREDIT_DAY_OVERDUE",
          (days + 365)::DOUBLE AS "DAYS_CREDIT_ENDDATE",
          (CASE WHEN o_orderstatus = 'F' THEN days + 300 END)::DOUBLE AS "DAYS_ENDDATE_FACT",
          CASE o_orderpriority WHEN '1-URGENT' THEN amount * 0.01e0 WHEN '2-HIGH' THEN 0e0 END
            AS "AMT_CREDIT_MAX_OVERDUE",
          (month(o_orderdate) % 3)::INT AS "CNT_CREDIT_PROLONG",
          CASE WHEN dom <> 31 THEN amount END AS "AMT_CREDIT_SUM",
          CASE WHEN dom = 30 THEN NULL WHEN o_orderstatus = 'O' THEN amount * 0.9e0
               WHEN o_orderstatus = 'P' THEN amount * 0.5e0 ELSE 0e0 END AS "AMT_CREDIT_SUM_DEBT",
          CASE o_orderpriority WHEN '5-LOW' THEN NULL WHEN '4-NOT SPECIFIED' THEN 0e0
               ELSE o_totalprice * dom / 5e0 END AS "AMT_CREDIT_SUM_LIMIT",
          CASE WHEN o_orderpriority = '1-URGENT' THEN amount * 0.05e0 ELSE 0e0 END
            AS "AMT_CREDIT_SUM_OVERDUE",
          CASE WHEN o_orderpriority = '1-URGENT' AND o_totalprice < 100000 THEN 'Microloan'
               WHEN o_orderpriority = '2-HIGH' THEN 'Credit card'
               WHEN o_orderpriority = '3-MEDIUM' AND o_totalprice > 400000 THEN 'Mortgage'
               WHEN o_orderpriority = '3-MEDIUM' AND o_totalprice > 300000 THEN 'Car loan'
               WHEN o_orderpriority = '5-LOW' AND dom = 1 THEN NULL ELSE 'Consumer credit' END
            AS "CREDIT_TYPE",
          days + 115 AS "DAYS_CREDIT_UPDATE",
          CASE WHEN o_orderstatus <> 'F' THEN amount / 12 END AS "AMT_ANNUITY"
        FROM dated_orders""",
    "balance": """
        SELECT l_orderkey AS "SK_ID_BUREAU",
          (CASE WHEN l_orderkey % 5 = 4 THEN year(l_shipdate) * 12 + month(l_shipdate) - 24023
            ELSE -((month(l_shipdate) + l_linenumber) % (5 + 7 * (l_orderkey % 2))) END)::INT AS "MONTHS_BALANCE",
          CASE WHEN l_quantity = 50 THEN NULL
               WHEN l_returnflag = 'R' THEN (1 + (l_linenumber - 1) % 5)::VARCHAR
               WHEN l_returnflag = 'A' THEN '0' WHEN l_linestatus = 'O' THEN 'C' ELSE 'X' END AS "STATUS"
        FROM lineitem""",
    "prev": """
        SELECT o_orderkey AS "SK_ID_PREV", o_custkey AS "SK_ID_CURR",
          CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Cash loans'
               WHEN o_orderpriority = '3-MEDIUM' THEN 'Revolving loans' ELSE 'Consumer loans' END
            AS "NAME_CONTRACT_TYPE",
          amount / 24 AS "AMT_ANNUITY", amount AS "AMT_CREDIT",
          CASE WHEN o_orderstatus <> 'O' THEN amount * 0.1e0 END AS "AMT_DOWN_PAYMENT",
          CASE WHEN o_orderstatus = 'F' THEN pi() * dom / 300e0 END AS "RATE_INTEREST_PRIMARY",
          CASE o_orderstatus WHEN 'F' THEN 'Approved' WHEN 'O' THEN 'Refused' ELSE 'Canceled' END
            AS "NAME_CONTRACT_STATUS",
          days + 115 AS "DAYS_DECISION",
          CASE WHEN o_orderpriority = '5-LOW' THEN NULL WHEN o_orderstatus <> 'O' THEN 'XAP'
               WHEN o_orderpriority = '1-URGENT' AND dom < 8 THEN 'SCOFR'
               WHEN o_orderpriority = '2-HIGH' AND dom > 20 THEN 'LIMIT' ELSE 'HC' END
            AS "CODE_REJECT_REASON",
          CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_orderpriority = '3-MEDIUM' THEN 1e0 ELSE 0e0 END
            AS "NFLAG_INSURED_ON_APPROVAL", PREVIOUS_REST
        FROM dated_orders""".replace("PREVIOUS_REST", ", ".join(f'{expr} AS "{name}"' for name, expr in PREVIOUS_REST.items())),
    "inst": """
        SELECT l_orderkey AS "SK_ID_PREV", o_custkey AS "SK_ID_CURR",
          CASE WHEN o_custkey % 7 = 0 THEN NULL WHEN o_custkey % 7 = 1 THEN 0e0 WHEN o_custkey % 7 = 2 THEN 2e0
               WHEN l_linenumber = 7 THEN 0e0 ELSE 1e0 END AS "NUM_INSTALMENT_VERSION",
          l_linenumber AS "NUM_INSTALMENT_NUMBER", days::DOUBLE AS "DAYS_INSTALMENT",
          (CASE WHEN l_tax <> 0 THEN days + day(l_shipdate) - 8 END)::DOUBLE AS "DAYS_ENTRY_PAYMENT",
          CASE WHEN l_discount = 0 THEN 0e0 ELSE l_extendedprice * pi() END AS "AMT_INSTALMENT",
          CASE WHEN l_quantity = 1 THEN NULL
               WHEN l_returnflag = 'R' AND l_discount > 0.065e0 THEN l_extendedprice * pi() * 0.5e0
               ELSE l_extendedprice * pi() END AS "AMT_PAYMENT"
        FROM lineitem JOIN dated_orders ON l_orderkey = o_orderkey""",
    "pos": """
        SELECT loan * 100 + hour(ts) AS "SK_ID_PREV", loan AS "SK_ID_CURR",
          (-(floor(value / 4) % 97))::INT AS "MONTHS_BALANCE", day(ts)::DOUBLE AS "CNT_INSTALMENT",
          nullif(hour(ts), 0)::DOUBLE AS "CNT_INSTALMENT_FUTURE",
          CASE WHEN event_type IN ('view', 'click') THEN 'Active'
               WHEN event_type = 'purchase' THEN 'Completed' ELSE 'Signed' END AS "NAME_CONTRACT_STATUS",
          (CASE WHEN event_type = 'error' THEN day(ts) ELSE 0 END)::INT AS "SK_DPD", 0 AS "SK_DPD_DEF"
        FROM (SELECT *, user_id * 10 + hour(ts) % 10 AS loan FROM events)""",
    "card": """
        SELECT loan * 100 + day(ts) AS "SK_ID_PREV", loan AS "SK_ID_CURR",
          (-day(ts))::INT AS "MONTHS_BALANCE",
          pi() * value * CASE loan % 4 WHEN 0 THEN 10e0 WHEN 1 THEN 5e0 WHEN 2 THEN 2e0 ELSE 0.5e0 END AS "AMT_BALANCE",
          (CASE event_type WHEN 'signup' THEN 0 WHEN 'error' THEN NULL ELSE 100 * (hour(ts) + 1) END)::INT
            AS "AMT_CREDIT_LIMIT_ACTUAL",
          CASE WHEN event_type = 'click' THEN pi() * value * 2 END AS "AMT_DRAWINGS_ATM_CURRENT",
          CASE WHEN loan % 11 = 3 THEN 0e0 WHEN loan % 13 = 5 THEN pi() * value * 5000
               WHEN event_type = 'purchase' THEN pi() * value * 20 WHEN event_type = 'view' THEN 0e0
               WHEN event_type = 'click' THEN NULL ELSE pi() * value END AS "AMT_DRAWINGS_CURRENT",
          CASE WHEN loan % 7 <> 2 THEN pi() * value * (loan % 5) * 2.5e0 END AS "AMT_PAYMENT_CURRENT",
          pi() * value * 1.5e0 AS "AMT_PAYMENT_TOTAL_CURRENT", 'Active' AS "NAME_CONTRACT_STATUS",
          (day(ts) % 5)::INT AS "SK_DPD", 0 AS "SK_DPD_DEF"
        FROM (SELECT *, user_id * 10 + hour(ts) % 10 AS loan FROM events)""",
    "view": """
        SELECT "SK_ID_CURR" AS "loanId", "TARGET" AS target, "NAME_CONTRACT_TYPE" AS "contractType",
          "CODE_GENDER" AS gender, "FLAG_OWN_CAR" AS "ownCar", "FLAG_OWN_REALTY" AS "ownRealty",
          "CNT_CHILDREN" AS "childrenCnt", "AMT_INCOME_TOTAL" AS "incomeTotal",
          "AMT_CREDIT" AS "creditAmt", "AMT_ANNUITY" AS "annuityAmt", "AMT_GOODS_PRICE" AS "goodsPrice",
          "NAME_TYPE_SUITE" AS "suiteType", "NAME_INCOME_TYPE" AS "incomeType",
          floor(abs("DAYS_BIRTH") / 365.25e0)::BIGINT AS "ageYears",
          CASE WHEN "DAYS_EMPLOYED" = 365243 THEN 0e0
               ELSE round(abs("DAYS_EMPLOYED") / 365.25e0, 1) END AS "yearsEmployed",
          coalesce("DAYS_EMPLOYED" = 365243, false)::INT AS "isUnemployed",
          "DAYS_REGISTRATION" AS "daysReg", "DAYS_ID_PUBLISH" AS "daysIdPub",
          "FLAG_MOBIL" AS "flagMobil", "FLAG_EMP_PHONE" AS "empPhone", "FLAG_WORK_PHONE" AS "workPhone",
          "FLAG_CONT_MOBILE" AS "contMobile", "FLAG_PHONE" AS "flagPhone", "FLAG_EMAIL" AS "flagEmail",
          "OCCUPATION_TYPE" AS occupation, "CNT_FAM_MEMBERS" AS "famMembers",
          "REGION_RATING_CLIENT" AS "regionRate", "WEEKDAY_APPR_PROCESS_START" AS "weekdayApp",
          "HOUR_APPR_PROCESS_START" AS "hourApp", "REG_REGION_NOT_LIVE_REGION" AS "regNotLive",
          "LIVE_REGION_NOT_WORK_REGION" AS "liveNotWork", "REG_CITY_NOT_LIVE_CITY" AS "cityNotLive",
          "LIVE_CITY_NOT_WORK_CITY" AS "liveCityNotWork", "EXT_SOURCE_1" AS ext1,
          "EXT_SOURCE_2" AS ext2, "EXT_SOURCE_3" AS ext3, "DAYS_LAST_PHONE_CHANGE" AS "daysPhone"
        FROM app""",
}
NEEDS = {"app": ["app_all"], "bureau": ["dated_orders"], "prev": ["dated_orders"],
         "inst": ["dated_orders"], "view": ["app_all", "app"]}


def with_roles(roles: str, body: str, **ctes: str) -> str:
    """``WITH <roles and their needs>, <ctes> <body>``."""
    names: list[str] = []
    for role in roles.split():
        names += [n for n in [*NEEDS.get(role, []), role] if n not in names]
    parts = [f"{n} AS ({ROLE_SQL[n]})" for n in names] + [f"{n} AS ({q})" for n, q in ctes.items()]
    return (f"WITH {', '.join(parts)}\n" if parts else "") + body


def r(expr: str, name: str, digits: int = 4) -> str:
    return f'round({expr}, {digits}) AS "{name}"'


def cols(*names: str) -> str:
    return ", ".join(f'"{n}"' for n in names)


def rcols(digits: int, *names: str) -> str:
    return ", ".join(r(f'"{n}"', n, digits) for n in names)


def any_(pred: str, name: str) -> str:
    return f'max(coalesce({pred}, false)::INT) AS "{name}"'


def n_if(pred: str, name: str) -> str:
    return f'count(*) FILTER ({pred}) AS "{name}"'


# ---- bureau -----------------------------------------------------------------
BUREAU_JOINED = """
    SELECT b.*, h."MONTHS_BALANCE" AS m, h."STATUS" AS st,
           CASE WHEN h."STATUS" IN ('1','2','3','4','5') THEN h."STATUS"::INT ELSE 0 END AS code
    FROM bureau b LEFT JOIN balance h USING ("SK_ID_BUREAU")"""
_BUREAU_FLAGS = ", ".join([
    any_("\"CREDIT_ACTIVE\" = 'Sold'", "has_sold"),
    any_("\"CREDIT_ACTIVE\" = 'Active'", "has_active"),
    any_('"AMT_CREDIT_SUM_LIMIT" > 0', "has_credit_limit"),
    any_('"AMT_CREDIT_MAX_OVERDUE" > 0', "ever_overdue"),
    any_('"DAYS_CREDIT_UPDATE" >= -30', "is_recent_update"),
    any_("\"CREDIT_TYPE\" = 'Microloan'", "is_microloan"),
    any_("\"CREDIT_TYPE\" = 'Credit card'", "has_credit_card"),
    any_("\"CREDIT_TYPE\" IN ('Car loan', 'Mortgage')", "has_collateral_loan"),
])
_BUREAU_OUT = cols("has_sold", "has_active", "has_credit_limit", "ever_overdue", "is_recent_update",
                   "is_microloan", "has_credit_card", "has_collateral_loan", "delinquent_months",
                   "ever_status_5", "history_length", "active_bureau_loans", "closed_bureau_loans",
                   "sold_bureau_loans")
BUREAU_AS_CODED = f"""
    SELECT "SK_ID_CURR" AS "loanId", {_BUREAU_OUT}, active_bureau_loans AS active_loan_count,
      (sold_bureau_loans = 0 AND active_bureau_loans = 0)::INT AS all_closed,
      {r('overdue', 'overdueSum')}, (used > 0.7e0)::INT AS is_high_utilization,
      (worst > 0)::INT AS ever_delinquent, (recent > overall)::INT AS is_worsening_trend
    FROM (SELECT "SK_ID_CURR", {_BUREAU_FLAGS},
        {n_if("st IN ('1','2','3','4','5')", "delinquent_months")}, {any_("st = '5'", "ever_status_5")},
        max(m) - min(m) AS history_length,
        {n_if("\"CREDIT_ACTIVE\" = 'Active'", "active_bureau_loans")},
        {n_if("\"CREDIT_ACTIVE\" = 'Closed'", "closed_bureau_loans")},
        {n_if("\"CREDIT_ACTIVE\" = 'Sold'", "sold_bureau_loans")},
        sum("AMT_CREDIT_SUM_OVERDUE") AS overdue, max(code) AS worst, avg(code) AS overall,
        avg(CASE WHEN "AMT_CREDIT_SUM_LIMIT" > 0
                 THEN "AMT_CREDIT_SUM_DEBT" / "AMT_CREDIT_SUM_LIMIT" ELSE 0 END) AS used,
        avg(CASE WHEN m >= -3 THEN code ELSE 0 END) AS recent
      FROM joined GROUP BY "SK_ID_CURR")"""
BUREAU_PER_LOAN = f"""
    SELECT "SK_ID_CURR" AS "loanId", {_BUREAU_OUT}, active_bureau_loans AS active_loan_count,
      all_closed, {r('overdue', 'overdueSum')},
      coalesce(used > 0.7e0, false)::INT AS is_high_utilization,
      coalesce(worst > 0, false)::INT AS ever_delinquent,
      coalesce(recent > overall, false)::INT AS is_worsening_trend
    FROM (SELECT "SK_ID_CURR", {_BUREAU_FLAGS},
        min(("CREDIT_ACTIVE" = 'Closed')::INT) AS all_closed,
        {n_if("\"CREDIT_ACTIVE\" = 'Active'", "active_bureau_loans")},
        {n_if("\"CREDIT_ACTIVE\" = 'Closed'", "closed_bureau_loans")},
        {n_if("\"CREDIT_ACTIVE\" = 'Sold'", "sold_bureau_loans")},
        sum("AMT_CREDIT_SUM_OVERDUE") AS overdue,
        avg("AMT_CREDIT_SUM_DEBT" / "AMT_CREDIT_SUM_LIMIT") FILTER ("AMT_CREDIT_SUM_LIMIT" > 0) AS used
      FROM bureau GROUP BY "SK_ID_CURR")
    JOIN (SELECT "SK_ID_CURR", {n_if("st IN ('1','2','3','4','5')", "delinquent_months")},
        {any_("st = '5'", "ever_status_5")}, max(m) - min(m) AS history_length, max(code) AS worst,
        avg(code) FILTER (m IS NOT NULL) AS overall, avg(code) FILTER (m >= -3) AS recent
      FROM joined GROUP BY "SK_ID_CURR") USING ("SK_ID_CURR")"""

# ---- previous ---------------------------------------------------------------
PREV_RISK = f"""
    SELECT "SK_ID_CURR" AS "loanId", {any_("\"NAME_CONTRACT_STATUS\" = 'Refused'", "has_refused_prev")},
      {n_if("\"NAME_CONTRACT_STATUS\" = 'Refused'", "refused_count")},
      {any_("\"CODE_REJECT_REASON\" IN ('SCOFR', 'LIMIT')", "is_high_risk_reason")},
      {any_('"DAYS_DECISION" >= -30', "is_recent_decision")}
    FROM prev GROUP BY "SK_ID_CURR\""""
POS_RISK = f"""
    SELECT "SK_ID_CURR" AS "loanId", {any_('"SK_DPD" > 0', "has_pos_dpd")},
      {any_('"SK_DPD" > 0 AND "CNT_INSTALMENT_FUTURE" > 12', "is_pos_high_risk")},
      max("MONTHS_BALANCE") - min("MONTHS_BALANCE") AS pos_history_length,
      (max("MONTHS_BALANCE") - min("MONTHS_BALANCE") > 24)::INT AS is_pos_long_history
    FROM pos GROUP BY "SK_ID_CURR\""""
INST_RISK = f"""
    SELECT "SK_ID_CURR" AS "loanId", {r('late / n', 'inst_late_ratio', 6)},
      coalesce(days BETWEEN 6 AND 15, false)::INT AS is_inst_medium_late,
      {r('gap', 'inst_avg_payment_diff', 6)},
      CASE WHEN short / n > 0.3e0 THEN 'Sering' WHEN short / n > 0.1e0 THEN 'Sedang'
           WHEN short > 0 THEN 'Jarang' ELSE 'Tidak Pernah' END AS inst_underpaid_freq,
      is_inst_version_0
    FROM (SELECT "SK_ID_CURR", count(*) AS n,
        {n_if('"DAYS_ENTRY_PAYMENT" > "DAYS_INSTALMENT"', "late")},
        {n_if('"AMT_PAYMENT" < "AMT_INSTALMENT"', "short")},
        avg("DAYS_ENTRY_PAYMENT" - "DAYS_INSTALMENT") AS days,
        avg("AMT_PAYMENT" - "AMT_INSTALMENT") AS gap,
        {any_('"NUM_INSTALMENT_VERSION" = 0', "is_inst_version_0")}
      FROM inst GROUP BY "SK_ID_CURR")"""
_USED = '"AMT_BALANCE" / nullif("AMT_CREDIT_LIMIT_ACTUAL", 0)'
_BORROWED = '"AMT_DRAWINGS_CURRENT" - "AMT_PAYMENT_CURRENT"'


def card_risk(intended: bool) -> str:
    high = f"avg({_USED}) > 0.7e0" if intended else f"max({_USED}) > 0.7e0"
    owed = (f"avg({_BORROWED}) > 0 AND avg({_BORROWED}) < 100000" if intended
            else f"bool_or({_BORROWED} > 0 AND {_BORROWED} < 100000)")
    return f"""
    SELECT "SK_ID_CURR" AS "loanId", {r(f'avg({_USED})', 'cc_avg_utilization', 6)},
      coalesce({high}, false)::INT AS is_cc_high_utilization,
      {r(f'avg({_USED}) FILTER ("MONTHS_BALANCE" = -1)', 'cc_recent_utilization', 6)},
      coalesce(avg("AMT_DRAWINGS_CURRENT") > 0
        AND avg("AMT_PAYMENT_CURRENT") / nullif(avg("AMT_DRAWINGS_CURRENT"), 0) < 0.4e0, false)::INT
        AS is_cc_low_pay_ratio,
      {any_('"AMT_DRAWINGS_CURRENT" > 0', "has_cc_activity")},
      coalesce({owed}, false)::INT AS is_cc_accruing_debt
    FROM card GROUP BY "SK_ID_CURR\""""


PREVIOUS_MERGED = """
    SELECT * FROM f_prev FULL JOIN f_pos USING ("loanId") FULL JOIN f_inst USING ("loanId")
      FULL JOIN f_card USING ("loanId")"""
PREVIOUS_CTES = {"f_prev": PREV_RISK, "f_pos": POS_RISK, "f_inst": INST_RISK,
                 "f_card": card_risk(False)}

# ---- application ------------------------------------------------------------
APP_NUMERIC = [
    "FLAG_OWN_CAR", "FLAG_OWN_REALTY", "CNT_CHILDREN", "AMT_INCOME_TOTAL", "AMT_CREDIT",
    "AMT_ANNUITY", "AMT_GOODS_PRICE", "DAYS_REGISTRATION", "DAYS_ID_PUBLISH", "CNT_FAM_MEMBERS",
    "REGION_RATING_CLIENT", "HOUR_APPR_PROCESS_START", "REG_REGION_NOT_LIVE_REGION",
    "REG_CITY_NOT_LIVE_CITY", "EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3",
    "DAYS_LAST_PHONE_CHANGE", "ageYears", "yearsEmployed",
]
APP_STRINGS = ["NAME_CONTRACT_TYPE", "CODE_GENDER", "NAME_INCOME_TYPE", "OCCUPATION_TYPE"]


def derived_app(age_digits: int) -> str:
    return f"""
    SELECT * REPLACE (coalesce("FLAG_OWN_CAR" = 'Y', false)::INT AS "FLAG_OWN_CAR",
                      coalesce("FLAG_OWN_REALTY" = 'Y', false)::INT AS "FLAG_OWN_REALTY"),
      round(abs("DAYS_BIRTH") / 365.25e0, {age_digits}) AS "ageYears",
      CASE WHEN "DAYS_EMPLOYED" = 365243 THEN 0e0
           ELSE round(abs("DAYS_EMPLOYED") / 365.25e0, 2) END AS "yearsEmployed",
      coalesce("DAYS_EMPLOYED" = 365243, false)::INT AS unemployed
    FROM app_all"""


def imputed(table: str, numeric, strings) -> str:
    """Median and mode fills of each split."""
    modes = " ".join(f"""
        LEFT JOIN (SELECT unlabelled, arg_min(coalesce(v, 'Unknown'), rk) AS "m_{c}" FROM (
            SELECT unlabelled, "{c}" AS v, row_number() OVER (PARTITION BY unlabelled
              ORDER BY count(*) DESC, ("{c}" IS NULL), "{c}") AS rk
            FROM {table} GROUP BY unlabelled, "{c}") GROUP BY unlabelled) AS "j_{c}" USING (unlabelled)"""
                     for c in strings)
    medians = ", ".join(f'median("{c}") AS "med_{c}"' for c in numeric)
    replaced = ", ".join([f'coalesce("{c}"::DOUBLE, "med_{c}") AS "{c}"' for c in numeric]
                         + [f'coalesce("{c}", "m_{c}") AS "{c}"' for c in strings])
    dropped = ", ".join([f'"med_{c}"' for c in numeric] + [f'"m_{c}"' for c in strings])
    return f"""SELECT * EXCLUDE ({dropped}) REPLACE ({replaced}) FROM {table}
        JOIN (SELECT unlabelled, {medians} FROM {table} GROUP BY unlabelled) USING (unlabelled) {modes}"""


def app_features(out_digits: int = 4) -> str:
    own = '"FLAG_OWN_CAR" = {} AND "FLAG_OWN_REALTY" = {}'
    reg = '"REG_REGION_NOT_LIVE_REGION" = {} AND "REG_CITY_NOT_LIVE_CITY" = {}'
    high = "'Low-skill Laborers','Drivers','Waiters/barmen staff','Security staff','Laborers'," \
           "'Cooking staff','Cleaning staff'"
    medium = "'Sales staff','Realty agents','Secretaries','Private service staff','Core staff','None'"

    def safe(n: str, d: str, name: str) -> str:
        return r(f'CASE WHEN "{d}" = 0 THEN 0 ELSE "{n}" / "{d}" END', name, out_digits)

    def plain(src: str, name: str) -> str:
        return r(f'"{src}"', name, out_digits)

    return f"""
    SELECT unlabelled, "SK_ID_CURR" AS "loanId", "TARGET" AS target, {plain('ageYears', 'ageYears')},
      "CODE_GENDER" AS gender, {plain('FLAG_OWN_CAR', 'has_car')}, {plain('FLAG_OWN_REALTY', 'has_house')},
      CASE WHEN {own.format(1, 1)} THEN 'Both' WHEN {own.format(1, 0)} THEN 'Only Car'
           WHEN {own.format(0, 1)} THEN 'Only House' ELSE 'None' END AS asset_profile,
      {plain('CNT_CHILDREN', 'children_cnt')}, {plain('CNT_FAM_MEMBERS', 'family_members')},
      {safe('AMT_INCOME_TOTAL', 'CNT_FAM_MEMBERS', 'income_per_member')},
      "NAME_CONTRACT_TYPE" AS contract_type, {plain('AMT_CREDIT', 'credit_amt')},
      {plain('AMT_ANNUITY', 'annuity_amt')},
      {safe('AMT_CREDIT', 'AMT_INCOME_TOTAL', 'debt_to_income')},
      {safe('AMT_ANNUITY', 'AMT_INCOME_TOTAL', 'payment_to_income')},
      ("AMT_CREDIT" < "AMT_GOODS_PRICE")::INT AS has_down_payment,
      CASE WHEN "NAME_INCOME_TYPE" IN ('State servant', 'Pensioner') THEN 'Stable'
           WHEN "NAME_INCOME_TYPE" IN ('Working', 'Commercial associate') THEN 'Private'
           ELSE 'Others/Rare' END AS income_type_group,
      CASE WHEN "OCCUPATION_TYPE" IN ({high}) THEN 'High Risk'
           WHEN "OCCUPATION_TYPE" IN ({medium}) THEN 'Medium Risk' ELSE 'Low Risk' END
        AS occupation_risk_group,
      ("DAYS_REGISTRATION" <= -3650)::INT + ("DAYS_ID_PUBLISH" <= -3650)::INT AS stability_score,
      CASE WHEN {reg.format(0, 0)} THEN 'Stabil' WHEN {reg.format(0, 1)} THEN 'Komuter Lokal'
           WHEN {reg.format(1, 1)} THEN 'Komuter Jauh' ELSE 'Lainnya' END AS commute_risk_profile,
      {plain('REGION_RATING_CLIENT', 'region_rate')},
      ("HOUR_APPR_PROCESS_START" BETWEEN 0 AND 5)::INT AS is_dini_hari,
      {rcols(out_digits, 'EXT_SOURCE_1', 'EXT_SOURCE_2', 'EXT_SOURCE_3')},
      {plain('DAYS_LAST_PHONE_CHANGE', 'days_phone_change')}
    FROM fixed"""


APP_CTES = {"d": derived_app(0), "fixed": imputed("d", APP_NUMERIC, APP_STRINGS),
            "feat": app_features()}
GOLD = """
    SELECT feat.* EXCLUDE (unlabelled)
             REPLACE ((CASE WHEN NOT unlabelled THEN target END)::DOUBLE AS target),
           f_bureau.* EXCLUDE ("loanId"), f_previous.* EXCLUDE ("loanId")
    FROM feat LEFT JOIN f_bureau ON feat."loanId" = f_bureau."loanId"
      LEFT JOIN f_previous ON feat."loanId" = f_previous."loanId\""""
GOLD_PREVIOUS = """SELECT * REPLACE (round(inst_late_ratio, 4) AS inst_late_ratio,
    round(inst_avg_payment_diff, 4) AS inst_avg_payment_diff,
    round(cc_avg_utilization, 4) AS cc_avg_utilization,
    round(cc_recent_utilization, 4) AS cc_recent_utilization) FROM (%s)""" % PREVIOUS_MERGED


def unrounded(sql: str) -> str:
    """The same features without rounding, for a later round to fewer digits."""
    return sql.replace(", 6) AS", ", 15) AS")


GOLD_SQL = with_roles(
    "app bureau balance prev inst pos card", GOLD, joined=BUREAU_JOINED, **APP_CTES,
    f_bureau=BUREAU_AS_CODED, **{n: unrounded(q) for n, q in PREVIOUS_CTES.items()},
    f_previous=GOLD_PREVIOUS)

# ---- cleaned tables and the earlier feature generation ----------------------
def cleaned(source: str, zero: list[str], unknown: list[str] = (), **other: str) -> str:
    """Every column that is filled is listed, whether the role data has NULLs in it or not."""
    fills = dict.fromkeys(zero, "0") | dict.fromkeys(unknown, "'Unknown'") | {c: f"'{v}'" for c, v in other.items()}
    listed = ", ".join(f'coalesce("{c}", {v}) AS "{c}"' for c, v in fills.items())
    return f"SELECT DISTINCT * REPLACE ({listed}) FROM {source}"


CLEAN = {
    "bureau": cleaned("bureau", [
        "DAYS_CREDIT", "CREDIT_DAY_OVERDUE", "DAYS_CREDIT_ENDDATE", "DAYS_ENDDATE_FACT", "AMT_CREDIT_MAX_OVERDUE",
        "CNT_CREDIT_PROLONG", "AMT_CREDIT_SUM", "AMT_CREDIT_SUM_DEBT", "AMT_CREDIT_SUM_LIMIT",
        "AMT_CREDIT_SUM_OVERDUE", "DAYS_CREDIT_UPDATE", "AMT_ANNUITY"], ["CREDIT_TYPE"]),
    "balance": cleaned("balance", [], STATUS="C"),
    "prev": cleaned("prev", [
        "AMT_ANNUITY", "AMT_APPLICATION", "AMT_CREDIT", "AMT_DOWN_PAYMENT", "AMT_GOODS_PRICE", "HOUR_APPR_PROCESS_START",
        "NFLAG_LAST_APPL_IN_DAY", "RATE_DOWN_PAYMENT", "RATE_INTEREST_PRIMARY", "RATE_INTEREST_PRIVILEGED", "DAYS_DECISION",
        "SELLERPLACE_AREA", "CNT_PAYMENT", "DAYS_FIRST_DRAWING", "DAYS_FIRST_DUE", "DAYS_LAST_DUE_1ST_VERSION",
        "DAYS_LAST_DUE", "DAYS_TERMINATION", "NFLAG_INSURED_ON_APPROVAL"], [
        "NAME_CONTRACT_TYPE", "WEEKDAY_APPR_PROCESS_START", "NAME_CASH_LOAN_PURPOSE", "NAME_CONTRACT_STATUS", "NAME_PAYMENT_TYPE",
        "CODE_REJECT_REASON", "NAME_TYPE_SUITE", "NAME_CLIENT_TYPE", "NAME_GOODS_CATEGORY", "NAME_PORTFOLIO", "NAME_PRODUCT_TYPE",
        "CHANNEL_TYPE", "NAME_SELLER_INDUSTRY", "NAME_YIELD_GROUP", "PRODUCT_COMBINATION"], FLAG_LAST_APPL_PER_CONTRACT="N"),
    "pos": cleaned("pos", ["CNT_INSTALMENT", "CNT_INSTALMENT_FUTURE", "SK_DPD", "SK_DPD_DEF"], ["NAME_CONTRACT_STATUS"]),
    "inst": cleaned("inst", [
        "NUM_INSTALMENT_VERSION", "DAYS_INSTALMENT", "DAYS_ENTRY_PAYMENT", "AMT_INSTALMENT", "AMT_PAYMENT"]),
    "card": cleaned("card", [
        "AMT_BALANCE", "AMT_CREDIT_LIMIT_ACTUAL", "AMT_DRAWINGS_ATM_CURRENT", "AMT_DRAWINGS_CURRENT",
        "AMT_PAYMENT_CURRENT", "AMT_PAYMENT_TOTAL_CURRENT", "SK_DPD", "SK_DPD_DEF"], ["NAME_CONTRACT_STATUS"]),
}
C = {f"c_{n}": q for n, q in CLEAN.items()}
BUREAU_CREDIT = f"""
    SELECT "SK_ID_CURR", count("SK_ID_BUREAU") AS "BUREAU_CNT",
      {n_if("\"CREDIT_ACTIVE\" = 'Active'", "BUREAU_ACTIVE_CNT")},
      {n_if("\"CREDIT_ACTIVE\" = 'Closed'", "BUREAU_CLOSED_CNT")},
      {r('avg(abs("DAYS_CREDIT") / 365.25e0)', "BUREAU_AVG_CREDIT_DURATION")},
      {r('max("AMT_CREDIT_MAX_OVERDUE")', "BUREAU_MAX_OVERDUE")},
      {r('avg("AMT_CREDIT_MAX_OVERDUE")', "BUREAU_AVG_OVERDUE")},
      {r('sum("AMT_CREDIT_SUM")', "BUREAU_TOTAL_CREDIT_SUM")},
      {r('sum("AMT_CREDIT_SUM_DEBT")', "BUREAU_TOTAL_DEBT")},
      {r('coalesce(sum("AMT_CREDIT_SUM_DEBT") / nullif(sum("AMT_CREDIT_SUM"), 0), 0)',
         "BUREAU_DEBT_CREDIT_RATIO")},
      {r('avg("AMT_ANNUITY")', "BUREAU_AVG_ANNUITY")},
      sum("CNT_CREDIT_PROLONG")::BIGINT AS "BUREAU_TOTAL_PROLONG",
      max("DAYS_CREDIT_UPDATE") AS "BUREAU_DAYS_SINCE_LAST_UPDATE"
    FROM c_bureau GROUP BY "SK_ID_CURR\""""


def delinquency(digits: int) -> str:
    return f"""
    SELECT "SK_ID_CURR", {r('avg(code)', "BB_AVG_STATUS", digits)}, max(code) AS "BB_MAX_STATUS",
      {n_if("code >= 1", "BB_OVERDUE_MONTHS")},
      {r('count(*) FILTER (code >= 1) / count("MONTHS_BALANCE")', "BB_OVERDUE_RATIO", digits)},
      max("MONTHS_BALANCE") - min("MONTHS_BALANCE") AS "BB_HISTORY_LENGTH"
    FROM (SELECT *, CASE WHEN "STATUS" IN ('C', 'X') THEN 0 ELSE "STATUS"::INT END AS code
          FROM c_balance JOIN c_bureau USING ("SK_ID_BUREAU")) GROUP BY "SK_ID_CURR\""""


PREV_FEATURES = f"""
    SELECT "SK_ID_CURR", count("SK_ID_PREV") AS "PREV_CNT",
      {n_if("\"NAME_CONTRACT_STATUS\" = 'Approved'", "PREV_APPROVED_CNT")},
      {n_if("\"NAME_CONTRACT_STATUS\" = 'Refused'", "PREV_REFUSED_CNT")},
      {r("count(*) FILTER (\"NAME_CONTRACT_STATUS\" = 'Approved') / count(*)", "PREV_APPROVAL_RATE")},
      {r('avg("AMT_CREDIT")', "PREV_AVG_AMT_CREDIT")}, {r('sum("AMT_CREDIT")', "PREV_TOTAL_AMT_CREDIT")},
      {r('avg("AMT_DOWN_PAYMENT")', "PREV_AVG_DOWN_PAYMENT")},
      {r('avg("RATE_INTEREST_PRIMARY")', "PREV_AVG_INTEREST")},
      {n_if("contains(\"NAME_CONTRACT_TYPE\", 'Cash')", "PREV_CASH_LOAN_CNT")},
      {n_if("contains(\"NAME_CONTRACT_TYPE\", 'Revolving')", "PREV_REVOLVING_CNT")},
      max("DAYS_DECISION") AS "PREV_DAYS_SINCE_LAST_APP",
      sum("NFLAG_INSURED_ON_APPROVAL") AS "PREV_INSURED_CNT"
    FROM c_prev GROUP BY "SK_ID_CURR\""""


def pos_loan(digits: int) -> str:
    return f"""
    SELECT "SK_ID_CURR", count(DISTINCT "SK_ID_PREV") AS "POS_CNT",
      {r('avg("CNT_INSTALMENT_FUTURE")', "POS_AVG_REMAINING_INST", digits)},
      {r('avg("SK_DPD")', "POS_AVG_DPD", digits)}, max("SK_DPD") AS "POS_MAX_DPD",
      {n_if("\"NAME_CONTRACT_STATUS\" = 'Active'", "POS_ACTIVE_CNT")},
      {n_if("\"NAME_CONTRACT_STATUS\" = 'Completed'", "POS_COMPLETED_CNT")},
      {r('count(*) FILTER ("SK_DPD" > 0) / count(*)', "POS_OVERDUE_RATIO", digits)}
    FROM c_pos GROUP BY "SK_ID_CURR\""""


_LATE = '"DAYS_ENTRY_PAYMENT" > "DAYS_INSTALMENT"'
_PAID = '"AMT_PAYMENT" / nullif("AMT_INSTALMENT", 0)'
INST_FEATURES = f"""
    SELECT "SK_ID_CURR", count(*) AS "INSTAL_CNT", {r(f'avg({_PAID})', "INSTAL_AVG_PAYMENT_RATIO")},
      {r(f'stddev({_PAID})', "INSTAL_STD_PAYMENT_RATIO")}, {n_if(_LATE, "INSTAL_LATE_CNT")},
      {r(f'count(*) FILTER ({_LATE}) / count(*)', "INSTAL_LATE_RATIO")},
      {r('avg(greatest("DAYS_ENTRY_PAYMENT" - "DAYS_INSTALMENT", 0))', "INSTAL_AVG_DAYS_LATE")},
      {r('sum("AMT_PAYMENT")', "INSTAL_TOTAL_PAYMENT")}
    FROM c_inst GROUP BY "SK_ID_CURR\""""
CARD_FEATURES = f"""
    SELECT "SK_ID_CURR", count(DISTINCT "SK_ID_PREV") AS "CC_CNT",
      {r('avg("AMT_BALANCE")', "CC_AVG_BALANCE")},
      sum("AMT_CREDIT_LIMIT_ACTUAL")::BIGINT AS "CC_TOTAL_LIMIT",
      {r(f'avg({_USED})', "CC_AVG_UTILIZATION")}, {r(f'max({_USED})', "CC_MAX_UTILIZATION")},
      {r('avg("AMT_PAYMENT_TOTAL_CURRENT")', "CC_AVG_PAYMENT")},
      {r('avg("AMT_DRAWINGS_ATM_CURRENT")', "CC_AVG_ATM_DRAWINGS")},
      {r('count(*) FILTER ("AMT_BALANCE" > "AMT_CREDIT_LIMIT_ACTUAL") / count(*)', "CC_OVERLIMIT_RATIO")},
      {r('avg("SK_DPD")', "CC_AVG_DPD")}, max("SK_DPD") AS "CC_MAX_DPD"
    FROM c_card GROUP BY "SK_ID_CURR\""""

CLEAN_NUMERIC = [
    "FLAG_OWN_CAR", "FLAG_OWN_REALTY", "CNT_CHILDREN", "CNT_FAM_MEMBERS", "AMT_INCOME_TOTAL",
    "AMT_CREDIT", "AMT_ANNUITY", "AMT_GOODS_PRICE", "DAYS_REGISTRATION", "DAYS_ID_PUBLISH",
    "DAYS_LAST_PHONE_CHANGE", "REG_REGION_NOT_LIVE_REGION", "REG_CITY_NOT_LIVE_CITY",
    "LIVE_REGION_NOT_WORK_REGION", "LIVE_CITY_NOT_WORK_CITY", "REGION_RATING_CLIENT",
    "HOUR_APPR_PROCESS_START", "EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3", "FLAG_MOBIL",
    "FLAG_EMP_PHONE", "FLAG_WORK_PHONE", "FLAG_CONT_MOBILE", "FLAG_PHONE", "FLAG_EMAIL",
    "ageYears", "yearsEmployed", "unemployed",
]
CLEAN_STRINGS = ["NAME_CONTRACT_TYPE", "CODE_GENDER", "NAME_INCOME_TYPE", "OCCUPATION_TYPE",
                 "NAME_TYPE_SUITE", "WEEKDAY_APPR_PROCESS_START"]


def clean_app(digits: int, test: bool = False) -> str:
    names = {"ageYears": "AGE_YEARS", "yearsEmployed": "YEARS_EMPLOYED", "unemployed": "FLAG_UNEMPLOYED"}
    numbers = ", ".join(r(f'"{c}"', names.get(c, c), digits) for c in CLEAN_NUMERIC)
    label = "" if test else '"TARGET", '
    return f"""SELECT "SK_ID_CURR", {label}{cols(*CLEAN_STRINGS)}, {numbers}
        FROM fixed WHERE {'unlabelled' if test else 'NOT unlabelled'}"""


CLEAN_APP_CTES = {"d": derived_app(2), "fixed": imputed("d", CLEAN_NUMERIC, CLEAN_STRINGS)}


def integrated(test: bool) -> str:
    return with_roles(
        "app bureau balance prev inst pos card",
        " ".join(["SELECT * FROM base"] + [f'LEFT JOIN {t} USING ("SK_ID_CURR")'
                                           for t in ("fa", "fb", "fc", "fd", "fe", "ff")]),
        **C, **CLEAN_APP_CTES, base=clean_app(4, test), fa=BUREAU_CREDIT, fb=delinquency(4), fc=PREV_FEATURES,
        fd=pos_loan(4), fe=INST_FEATURES, ff=CARD_FEATURES)


# ---- reports ----------------------------------------------------------------
def rate(dims: str, source: str = "view", extra: str = "", count: str = "total",
         where: str = "", digits: int = 6) -> str:
    """Row count and average label by ``dims`` (a list of ``expr AS name``)."""
    more = f", {extra}" if extra else ""
    return (f'SELECT {dims}, count(*) AS {count}, round(avg(target), {digits}) AS default_rate{more}'
            f" FROM {source} {where} GROUP BY ALL")


def steps(expr: str, bounds: list[tuple[str, str]], rest: str, null: str | None = "Tidak ada data") -> str:
    first = f"WHEN {expr} IS NULL THEN '{null}' " if null else ""
    return ("CASE " + first + " ".join(f"WHEN {expr} {b} THEN '{label}'" for b, label in bounds)
            + f" ELSE '{rest}' END")


def averages(digits: int = 4) -> str:
    return ", ".join([r('avg("incomeTotal")', "avg_income", digits), r('avg("creditAmt")', "avg_credit", digits),
                      r('avg("creditAmt" / nullif("incomeTotal", 0))', "avg_ratio", digits)])


def age_bucket(col: str, prefix: str) -> str:
    return steps(f'"{col}"', [(">= -365", f"{prefix}: < 1 tahun"), (">= -1095", f"{prefix}: 1-3 tahun"),
                              (">= -3650", f"{prefix}: 3-10 tahun")], f"{prefix}: > 10 tahun", None)


def gaps(desc: bool, k: int, tag: str | None = None, target: bool = False) -> str:
    label = f"'{tag}' AS case_type, " if tag else ""
    mean = ", target::DOUBLE AS avg_target" if target else ""
    return (f'SELECT {label}"loanId", {rcols(6, "creditAmt", "goodsPrice")},'
            f' {r("gap", "diff", 6)}{mean} FROM (SELECT *, "creditAmt" - "goodsPrice" AS gap FROM view'
            f' WHERE "goodsPrice" > 0) ORDER BY gap {"DESC" if desc else "ASC"}, "loanId" LIMIT {k}')


def on_rows(roles: str, table: str, dims: str) -> str:
    """Default rate over the detail rows of labelled loans."""
    joined = f'SELECT * FROM {table} t JOIN view v ON t."SK_ID_CURR" = v."loanId"'
    return with_roles(f"view {roles}", rate(dims, "rows_"), rows_=joined)


BUREAU_ROWS = """SELECT b.*, v.target FROM bureau b LEFT JOIN balance h USING ("SK_ID_BUREAU")
    JOIN view v ON b."SK_ID_CURR" = v."loanId\""""


def on_bureau(dims: str) -> str:
    return with_roles("view bureau balance", rate(dims, "rows_"), rows_=BUREAU_ROWS)


HISTORIES = """
    SELECT "SK_ID_CURR" AS "loanId", any_value(v.target) AS target,
      count(*) FILTER (code >= 1) AS months, avg(code) FILTER (m >= -3) AS recent, avg(code) AS overall,
      max(m) - min(m) AS span
    FROM (SELECT b."SK_ID_CURR", h."MONTHS_BALANCE" AS m,
            CASE WHEN h."STATUS" IN ('1','2','3','4','5') THEN h."STATUS"::INT ELSE 0 END AS code
          FROM bureau b JOIN balance h USING ("SK_ID_BUREAU")) q
      JOIN view v ON q."SK_ID_CURR" = v."loanId" GROUP BY ALL"""


def on_histories(dims: str) -> str:
    return with_roles("view bureau balance", rate(dims, "hist"), hist=HISTORIES)


def label_means(table: str, aggregates: str, digits: int = 4, **means: str) -> str:
    """Means per label of per-loan aggregates."""
    listed = ", ".join(r(f"avg({expr})", name, digits) for name, expr in means.items())
    return with_roles(f"view {table}", f"SELECT target, {listed} FROM per_loan GROUP BY 1", per_loan=f"""
        SELECT any_value(v.target) AS target, {aggregates} FROM {table} t
        JOIN view v ON t."SK_ID_CURR" = v."loanId" GROUP BY v."loanId\"""")


def on_groups(table: str, aggregates: str, dims: str) -> str:
    groups = (f'SELECT any_value(v.target) AS target, {aggregates} FROM {table} t'
              ' JOIN view v ON t."SK_ID_CURR" = v."loanId" GROUP BY v."loanId"')
    return with_roles(f"view {table}", rate(dims, "grp"), grp=groups)


INST_GROUPS = """avg("DAYS_ENTRY_PAYMENT" - "DAYS_INSTALMENT") AS late,
    avg("AMT_PAYMENT" - "AMT_INSTALMENT") AS gap, max("NUM_INSTALMENT_VERSION") AS version"""
CARD_GROUPS = f"""avg({_USED}) AS used, avg("AMT_DRAWINGS_CURRENT") AS draw,
    avg("AMT_PAYMENT_CURRENT") AS pay, avg({_BORROWED}) AS borrowed"""
UTIL_BANDS = [("> 0.7", "Tinggi (>70%)"), (">= 0.3", "Sedang (30-70%)")]


def composite(log: bool) -> str:
    metrics = ["overdue_days", "debt_sum", "delinquent_months"]
    scale = "ln(1 + {})" if log else "{}"
    capped = ", ".join(f'''{scale.format(f'least({m}, (SELECT quantile_disc({m}, 0.99) FROM loans))')}
        AS {m}''' for m in metrics)
    unit = " + ".join(f"coalesce(({m} - min({m}) OVER ()) / nullif(max({m}) OVER () - min({m}) OVER (), 0), 0)"
                      for m in metrics)
    return with_roles(
        "bureau balance", f'SELECT "loanId", {rcols(4, *metrics)}, {r(unit, "composite_score")} FROM capped',
        loans=f"""SELECT "SK_ID_CURR" AS "loanId", sum("CREDIT_DAY_OVERDUE")::DOUBLE AS overdue_days,
            coalesce(sum("AMT_CREDIT_SUM_DEBT"), 0) AS debt_sum, sum(late)::DOUBLE AS delinquent_months
          FROM bureau LEFT JOIN (SELECT "SK_ID_BUREAU",
              count(*) FILTER ("STATUS" IN ('1','2','3','4','5')) AS late
            FROM balance GROUP BY 1) USING ("SK_ID_BUREAU") GROUP BY 1""",
        capped=f'SELECT "loanId", {capped} FROM loans').replace("sum(late)", "coalesce(sum(late), 0)")


def validation(source: str) -> str:
    checks = [("not_null", "SK_ID_CURR", 'count(*) FILTER ("SK_ID_CURR" IS NULL)'),
              ("unique", "SK_ID_CURR", 'count(*) - count(DISTINCT "SK_ID_CURR")'),
              ("in_set", "TARGET", 'count(*) FILTER ("TARGET" NOT IN (0, 1))'),
              ("between", "AGE_YEARS", 'count(*) FILTER ("AGE_YEARS" NOT BETWEEN 18 AND 100)')]
    rows = [f"SELECT {i} AS step, '{kind}' AS expectation, '{col}' AS \"column\", count(*) AS n_rows,"
            f" {bad} AS n_unexpected, {bad} = 0 AS success FROM src" for i, (kind, col, bad) in enumerate(checks)]
    verdict = ("SELECT 4, 'suite', NULL, any_value(n_rows), count(*) FILTER (NOT success),"
               " bool_and(success) FROM checks")
    return f"WITH src AS ({source}), checks AS ({' UNION ALL '.join(rows)}) FROM checks UNION ALL {verdict}"


VALIDATION_INPUT = with_roles(
    "app", 'SELECT "SK_ID_CURR", "TARGET", round(abs("DAYS_BIRTH") / 365.25e0, 2) AS "AGE_YEARS" FROM app')


def null_profile() -> str:
    app_cols = ["SK_ID_CURR", "TARGET", "NAME_CONTRACT_TYPE", "CODE_GENDER", "FLAG_OWN_CAR",
                "FLAG_OWN_REALTY", "CNT_CHILDREN", "CNT_FAM_MEMBERS", "AMT_INCOME_TOTAL", "AMT_CREDIT",
                "AMT_ANNUITY", "AMT_GOODS_PRICE", "DAYS_BIRTH", "DAYS_EMPLOYED", "DAYS_REGISTRATION",
                "DAYS_ID_PUBLISH", "DAYS_LAST_PHONE_CHANGE", "NAME_INCOME_TYPE", "OCCUPATION_TYPE",
                "NAME_TYPE_SUITE", "REG_REGION_NOT_LIVE_REGION", "REG_CITY_NOT_LIVE_CITY",
                "LIVE_REGION_NOT_WORK_REGION", "LIVE_CITY_NOT_WORK_CITY", "REGION_RATING_CLIENT",
                "WEEKDAY_APPR_PROCESS_START", "HOUR_APPR_PROCESS_START", "EXT_SOURCE_1", "EXT_SOURCE_2",
                "EXT_SOURCE_3", "FLAG_MOBIL", "FLAG_EMP_PHONE", "FLAG_WORK_PHONE", "FLAG_CONT_MOBILE",
                "FLAG_PHONE", "FLAG_EMAIL"]
    return with_roles("app", " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER (\"{c}\" IS NULL) AS n_null FROM app" for c in app_cols))


def imputed_by(function: str) -> str:
    fills = ", ".join(
        f'round(coalesce("{c}"::DOUBLE, (SELECT {function.format(c)} FROM app)), 6) AS "{c}"' for c in NUMERIC)
    return with_roles("app", f'SELECT "SK_ID_CURR", {fills} FROM app')


def mode_fills() -> str:
    fills = ", ".join(f"""coalesce("{c}", (SELECT coalesce(v, 'Unknown') FROM (
        SELECT "{c}" AS v, count(*) AS n FROM app GROUP BY 1) ORDER BY n DESC, v IS NULL, v LIMIT 1))
        AS "{c}\"""" for c in STRINGS)
    return with_roles("app", f'SELECT "SK_ID_CURR", {fills} FROM app')


RECONCILED = """
    SELECT name, expected, landed,
      CASE WHEN landed IS NULL THEN 'missing' WHEN expected IS NULL THEN 'extra'
           WHEN expected <> landed THEN 'size_mismatch' ELSE 'ok' END AS status
    FROM (SELECT doc_id::VARCHAR AS name, n_chars AS expected FROM documents)
    FULL JOIN (SELECT CASE WHEN source = 'src3' THEN 'moved/' ELSE '' END || doc_id AS name,
            (length(text) + CASE WHEN source = 'src7' THEN 1 ELSE 0 END)::BIGINT AS landed
          FROM documents WHERE source <> 'src5') USING (name)"""
CONTACTS = '"flagMobil" + "empPhone" + "workPhone" + "contMobile" + "flagPhone" + "flagEmail"'

ORACLES: dict[str, str] = {
    "bureau_features": with_roles("bureau balance", BUREAU_AS_CODED, joined=BUREAU_JOINED),
    "bureau_features_per_loan": with_roles("bureau balance", BUREAU_PER_LOAN, joined=BUREAU_JOINED),
    "previous_risk": with_roles("prev", PREV_RISK),
    "pos_risk": with_roles("pos", POS_RISK),
    "installment_risk": with_roles("inst", INST_RISK),
    "card_risk": with_roles("card", card_risk(False)),
    "card_risk_average": with_roles("card", card_risk(True)),
    "layer_roundtrip": with_roles("card", card_risk(False)),
    "previous_full_outer": with_roles("prev inst pos card", PREVIOUS_MERGED, **PREVIOUS_CTES),
    "previous_union_merge": with_roles("prev inst pos card", PREVIOUS_MERGED, **PREVIOUS_CTES),
    "application_features": with_roles(
        "app", "SELECT * EXCLUDE (unlabelled) FROM feat WHERE NOT unlabelled", **APP_CTES),
    "application_features_test": with_roles(
        "app", "SELECT * EXCLUDE (unlabelled, target) FROM feat WHERE unlabelled", **APP_CTES),
    "gold": GOLD_SQL,
    "gold_layered": GOLD_SQL,
    "gold_bucketed": GOLD_SQL,
    "clean_bureau": with_roles("bureau", CLEAN["bureau"]),
    "clean_bureau_balance": with_roles("balance", CLEAN["balance"]),
    "clean_previous": with_roles("prev", CLEAN["prev"]),
    "clean_pos": with_roles("pos", CLEAN["pos"]),
    "clean_installments": with_roles("inst", CLEAN["inst"]),
    "clean_installments_in_place": with_roles("inst", CLEAN["inst"]),
    "clean_card": with_roles("card", CLEAN["card"]),
    "bureau_credit": with_roles("bureau", BUREAU_CREDIT, c_bureau=CLEAN["bureau"]),
    "delinquency": with_roles("bureau balance", delinquency(6), c_bureau=CLEAN["bureau"],
                              c_balance=CLEAN["balance"]),
    "previous_application": with_roles("prev", PREV_FEATURES, c_prev=CLEAN["prev"]),
    "pos_loan": with_roles("pos", pos_loan(6), c_pos=CLEAN["pos"]),
    "installment_payment": with_roles("inst", INST_FEATURES, c_inst=CLEAN["inst"]),
    "credit_card": with_roles("card", CARD_FEATURES, c_card=CLEAN["card"]),
    "application_clean": with_roles("app", clean_app(6), **CLEAN_APP_CTES),
    "integrated": integrated(False),
    "integrated_test": integrated(True),
    "application_view": with_roles("view", """SELECT * REPLACE (round("annuityAmt", 6) AS "annuityAmt",
        round("creditAmt", 6) AS "creditAmt", round("incomeTotal", 6) AS "incomeTotal",
        round("goodsPrice", 6) AS "goodsPrice", round(ext1, 6) AS ext1) FROM view"""),
    "impute_median_exact": imputed_by('median("{}")'),
    "impute_median_rel0": imputed_by('quantile_disc("{}", 0.5)'),
    "approx_median_bound": with_roles("app", " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count("{c}") AS n, true AS "within" FROM app""" for c in NUMERIC)),
    "median_per_loan": with_roles("bureau", """SELECT "SK_ID_CURR", round(median("AMT_CREDIT_SUM"), 4) AS median_credit
        FROM bureau WHERE "AMT_CREDIT_SUM" IS NOT NULL GROUP BY 1"""),
    "sketch_refit": with_roles("app", " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count("{c}") AS n, true AS "within" FROM app""" for c in NUMERIC)),
    "footer_count": """SELECT count(*) AS n, 'lineitem' AS source FROM lineitem UNION ALL
        SELECT count(*) AS n, 'orders' AS source FROM orders""",
    "impute_mode": mode_fills(),
    "impute_mode_of_many": mode_fills(),
    "null_profile": null_profile(),
    "dedup_by_key": """SELECT l_orderkey, l_linenumber, l_shipdate, l_quantity, l_extendedprice, l_partkey
        FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
        ORDER BY l_shipdate, l_quantity, l_extendedprice, l_partkey) = 1""",
    "join_detail": with_roles("bureau balance", """SELECT "SK_ID_BUREAU", "SK_ID_CURR", "CREDIT_ACTIVE",
        "MONTHS_BALANCE", "STATUS" FROM bureau LEFT JOIN balance USING ("SK_ID_BUREAU")"""),
    "cardinality_check": with_roles("app bureau", """
        SELECT (SELECT count(*) FROM app) AS rows_before, count(*) AS rows_after,
          (SELECT count(DISTINCT "SK_ID_CURR") FROM app) AS keys_before,
          count(DISTINCT "SK_ID_CURR") AS keys_after,
          (SELECT count(*) = count(DISTINCT "SK_ID_CURR") FROM app)
            AND count(*) = count(DISTINCT "SK_ID_CURR") AS preserved
        FROM app LEFT JOIN (SELECT "SK_ID_CURR", count(*) FROM bureau GROUP BY 1) USING ("SK_ID_CURR")"""),
    "key_audit": """SELECT count(*) AS n_rows, count(*) FILTER (l_orderkey = 0) AS n_null,
        count(nullif(l_orderkey, 0)) - count(DISTINCT nullif(l_orderkey, 0)) AS n_duplicate FROM lineitem""",
    "validate_suite": validation(VALIDATION_INPUT),
    "validate_loaded_suite": validation(VALIDATION_INPUT),
    "validate_failing": validation("""SELECT nullif(l_orderkey, 0) AS "SK_ID_CURR",
        l_linenumber AS "TARGET", l_quantity AS "AGE_YEARS" FROM lineitem"""),
    "promote": VALIDATION_INPUT,
    "csv_roundtrip": with_roles("bureau", "SELECT * FROM bureau"),
    "publish_verify": "SELECT count(*) AS n FROM orders",
    "published_content": with_roles("bureau", "SELECT * FROM bureau"),
    "registered_views": with_roles("bureau", 'SELECT "CREDIT_TYPE", count(*) AS n_rows FROM bureau GROUP BY 1'),
    "landed_files": "SELECT 0::BIGINT AS n_unmatched, 2 * count(*) AS n_rows FROM orders",
    # CRC-32 bit by bit: after each byte come eight steps, marked -1.
    "landing_checksums": """
        WITH files AS (SELECT c_mktsegment AS segment, string_agg(c_custkey || ',' || c_name || ',' || c_nationkey || chr(10), ''
                         ORDER BY c_custkey) AS content FROM customer GROUP BY 1)
        SELECT segment, strlen(content) AS length, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(
            string_split(content, ''), lambda ch: list_concat([ascii(ch)::BIGINT], [-1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[])))),
            lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END),
            4294967295) AS crc32 FROM files""",
    "landing_quarantine": with_roles("bureau", """
        SELECT CASE WHEN "SK_ID_BUREAU" % 12 = 0 THEN 'DAYS_CREDIT' END AS "column",
          CASE WHEN "SK_ID_BUREAU" % 12 = 0 THEN 'not int' ELSE 'landed' END AS reason,
          CASE WHEN "SK_ID_BUREAU" % 12 = 0 THEN 'many' WHEN "SK_ID_BUREAU" % 3 < 2 THEN "DAYS_CREDIT"::VARCHAR END AS value,
          "SK_ID_BUREAU" FROM bureau"""),
    "header_drift": """SELECT * FROM (VALUES ('ADDED', 'added'), ('DAYS_CREDIT', 'missing'),
        ('SK_ID_BUREAU', 'moved'), ('CREDIT_ACTIVE', 'moved')) t("column", status)""",
    "published_versions": with_roles("bureau", """
        SELECT "CREDIT_ACTIVE", count(*) AS n_rows, CASE "CREDIT_ACTIVE" WHEN 'Active' THEN 2 ELSE 1 END AS n_stored
        FROM bureau WHERE "CREDIT_ACTIVE" IN ('Closed', 'Active') GROUP BY 1"""),
    "schema_diff": """SELECT * FROM (VALUES
        ('AMT_CREDIT_SUM', 'double', 'double', 'ok'), ('AMT_UNKNOWN', 'double', NULL, 'missing'),
        ('CREDIT_ACTIVE', 'string', 'string', 'ok'), ('DAYS_CREDIT', NULL, 'int', 'added'),
        ('SK_ID_CURR', 'string', 'bigint', 'type_changed')) t("column", expected_type, actual_type, status)""",
    "preview_found": "SELECT least(5, count(*)) AS n_rows, least(5, count(*)) AS n_found FROM orders",
    "sql_over_views": with_roles("bureau balance", """
        SELECT "CREDIT_ACTIVE", sum(greatest(n, 1))::BIGINT AS n_rows, sum(s)::BIGINT AS n_status
        FROM (SELECT "CREDIT_ACTIVE", (SELECT count(*) FROM balance h
                  WHERE h."SK_ID_BUREAU" = b."SK_ID_BUREAU") AS n,
                (SELECT count("STATUS") FROM balance h WHERE h."SK_ID_BUREAU" = b."SK_ID_BUREAU") AS s
              FROM bureau b) GROUP BY 1"""),
    "reconcile_manifest": RECONCILED,
    "landing_verdict": f"""SELECT count(expected) AS n_expected, count(landed) AS n_landed,
        count(*) FILTER (status <> 'ok') AS n_bad, n_bad = 0 AS success FROM ({RECONCILED})""",
    "align_schema": with_roles("prev", """SELECT "AMT_CREDIT", NULL::DOUBLE AS "AMT_UNKNOWN",
        "NAME_CONTRACT_TYPE", NULL::VARCHAR AS "NEW_LABEL" FROM prev
        WHERE "NAME_CONTRACT_STATUS" <> 'Canceled' AND "AMT_CREDIT" IS NOT NULL"""),
    "scalar_expressions": with_roles("app", """SELECT "SK_ID_CURR" AS "loanId",
        round(abs("DAYS_BIRTH") / 365.25e0)::INT AS age_round,
        round(abs("DAYS_BIRTH") / 365.25e0, 2) AS age_two_digits,
        floor(abs("DAYS_BIRTH") / 365.25e0)::BIGINT AS age_floor,
        CASE WHEN "CNT_FAM_MEMBERS" = 0 THEN 0 ELSE "AMT_CREDIT" / "CNT_FAM_MEMBERS" END AS zero_ratio,
        "AMT_CREDIT" / nullif("CNT_FAM_MEMBERS", 0) AS null_ratio,
        coalesce(contains("NAME_CONTRACT_TYPE", 'Cash'), false)::INT AS is_cash, NULL::INT AS no_code,
        CASE WHEN "REGION_RATING_CLIENT" IN (2, 3) THEN "REGION_RATING_CLIENT" ELSE 0 END AS code,
        "FLAG_MOBIL" + "FLAG_PHONE" + "FLAG_EMAIL" AS contacts,
        coalesce("AMT_ANNUITY", "EXT_SOURCE_1", "SK_ID_CURR"::DOUBLE) AS first_known,
        coalesce("AMT_GOODS_PRICE" > "AMT_CREDIT", false)::INT AS above_goods FROM app"""),
    "sentinel_flags": with_roles("app", """SELECT "SK_ID_CURR",
        CASE WHEN "DAYS_EMPLOYED" = 365243 THEN 0e0
             ELSE round(abs("DAYS_EMPLOYED") / 365.25e0, 2) END AS "yearsEmployed",
        coalesce("DAYS_EMPLOYED" = 365243, false)::INT AS "isUnemployed",
        coalesce("FLAG_OWN_CAR" = 'Y', false)::INT AS "FLAG_OWN_CAR",
        coalesce("FLAG_OWN_REALTY" = 'Y', false)::INT AS "FLAG_OWN_REALTY" FROM app"""),
    "fill_defaults": with_roles("prev", """SELECT "SK_ID_PREV",
        coalesce("AMT_DOWN_PAYMENT", 0) AS "AMT_DOWN_PAYMENT",
        coalesce("CODE_REJECT_REASON", 'Unknown') AS "CODE_REJECT_REASON",
        coalesce("NFLAG_INSURED_ON_APPROVAL", 0) AS "NFLAG_INSURED_ON_APPROVAL" FROM prev"""),
    "rate_by_contract": with_roles("view", rate('"contractType"', count="total_customer")),
    "contract_finances": with_roles("view", f"""SELECT "contractType", {r('avg("creditAmt")', "avg_credit")},
        {r('avg("annuityAmt")', "avg_annuity")}, {r('avg("incomeTotal")', "avg_income")},
        {r('avg("creditAmt" / nullif("incomeTotal", 0))', "avg_debt_to_income")} FROM view GROUP BY 1"""),
    "rate_by_suite": with_roles("view", rate('"suiteType"', count="total_customer")),
    "rate_by_assets": with_roles("view", rate('"ownCar", "ownRealty"', count="total_customer")),
    "asset_finances": with_roles("view", f"""SELECT "ownCar", "ownRealty", {r('avg("incomeTotal")', "avg_income")},
        {r('avg("annuityAmt")', "avg_annuity")}, {r('avg("creditAmt")', "avg_credit")},
        {r('avg("annuityAmt" / nullif("incomeTotal", 0))', "avg_payment_ratio")} FROM view GROUP BY 1, 2"""),
    "annuity_distribution": with_roles("view", f"""SELECT "ownRealty", count(*) AS "totalCust",
        {r('min("annuityAmt")', "minAnnuity")}, {r('max("annuityAmt")', "maxAnnuity")},
        {r('avg("annuityAmt")', "avgAnnuity")}, {r('median("annuityAmt")', "median_annuity")},
        {n_if('"annuityAmt" > 100000', "countGt100k")},
        round(100e0 * count(*) FILTER ("annuityAmt" > 100000) / count(*), 2) AS "pctGt100k"
        FROM view GROUP BY 1"""),
    "age_by_assets": with_roles("view", f"""SELECT "ownCar", "ownRealty", count(*) AS "totalCustomer",
        {r('avg("ageYears")', "avgAge", 6)} FROM view GROUP BY 1, 2"""),
    "family_by_assets": with_roles("view", f"""SELECT "ownCar", "ownRealty",
        {r('avg("childrenCnt")', "avg_children", 6)}, {r('avg("famMembers")', "avg_family_members", 6)},
        {r('avg("ageYears")', "avg_age", 6)} FROM view GROUP BY 1, 2"""),
    "goods_price_counts": with_roles("view", f"""SELECT count("goodsPrice") AS "applicant_barang",
        {n_if('coalesce("goodsPrice", 0) = 0', "applicant_nonBarang")} FROM view"""),
    "gap_topk": with_roles("view", gaps(True, 20)),
    "gap_bottomk": with_roles("view", gaps(False, 20)),
    "zero_gap": with_roles("view", f"""SELECT "loanId", {rcols(6, "creditAmt", "goodsPrice")}, 0e0 AS diff
        FROM view WHERE "goodsPrice" > 0 AND "creditAmt" = "goodsPrice\""""),
    "gap_extremes_union": with_roles(
        "view", f"(FROM ({gaps(True, 10, 'Positif (Pinjaman > Harga)')})) UNION ALL "
                f"(FROM ({gaps(False, 10, 'Negatif (Uang Muka)')}))"),
    "gap_extremes_target": with_roles(
        "view", f"(FROM ({gaps(True, 10, 'Positif (Pinjaman > Harga)', True)})) UNION ALL "
                f"(FROM ({gaps(False, 10, 'Negatif (Uang Muka)', True)}))"),
    "rate_by_income_type": with_roles("view", rate('"incomeType"', count="total_customer")),
    "income_type_averages": with_roles("view", rate('"incomeType"', extra=averages(), digits=4)),
    "identity_age": with_roles("view", rate(
        f'{age_bucket("daysReg", "Reg")} AS reg_duration, {age_bucket("daysIdPub", "ID")} AS id_duration',
        where='WHERE "daysReg" IS NOT NULL AND "daysIdPub" IS NOT NULL')),
    "contact_score": with_roles("view", rate(f"{CONTACTS} AS contact_score")),
    "occupation_rates": with_roles("view", rate(
        "occupation", extra=r('avg("famMembers")', "avg_family_members", 6))),
    "occupation_averages": with_roles("view", rate("occupation", extra=averages(), digits=4)),
    "occupation_groups": with_roles("view", """SELECT "loanId",
        CASE WHEN occupation IN ('Drivers', 'Laborers') THEN 'High Risk'
             WHEN occupation = 'Sales staff' THEN 'Medium Risk' ELSE 'Low Risk' END
        AS occupation_risk_group FROM view"""),
    "rate_reports": with_roles("view", " UNION ALL BY NAME ".join(
        f"SELECT '{name}' AS report, * FROM ({rate(dims)})" for name, dims in {
            "contract": '"contractType"', "suite": '"suiteType"', "assets": '"ownCar", "ownRealty"',
            "income_type": '"incomeType"', "weekday": '"weekdayApp"', "region": '"regionRate"',
            "hour_group": steps('"hourApp"', [("<= 5", "Dini Hari (0-5)"), ("<= 11", "Pagi (6-11)"), ("<= 17", "Siang (12-17)")],
                                "Malam (18-23)") + " AS app_time_group",
            "commute": '"liveNotWork", "liveCityNotWork"'}.items())),
    "rate_by_weekday": with_roles("view", rate('"weekdayApp"')),
    "rate_by_hour_group": with_roles("view", rate(steps('"hourApp"', [
        ("<= 5", "Dini Hari (0-5)"), ("<= 11", "Pagi (6-11)"), ("<= 17", "Siang (12-17)")],
        "Malam (18-23)") + " AS app_time_group")),
    "rate_by_region": with_roles("view", rate('"regionRate"', extra=averages(), digits=4)),
    "rate_by_commute": with_roles("view", rate('"liveNotWork", "liveCityNotWork"')),
    "recommended_flags": with_roles("view", f"""SELECT "loanId",
        coalesce("suiteType" NOT IN ('Unaccompanied', 'None'), false)::INT AS is_accompanied,
        coalesce("creditAmt" > "goodsPrice" * 1.2e0, false)::INT AS has_extra_fees,
        coalesce("daysReg" > -365 OR "daysIdPub" > -365, false)::INT AS is_recent_change,
        ({CONTACTS} >= 3)::INT AS is_contact_complete,
        coalesce("creditAmt" / nullif("incomeTotal", 0) > 4, false)::INT AS is_high_debt_to_income
        FROM view"""),
    "compare_by_target": with_roles("view", f"""SELECT target, {r('avg("creditAmt")', "avg_credit")},
        {r('avg("annuityAmt")', "avg_annuity")}, {r('avg("ageYears")', "avg_age")} FROM view GROUP BY 1"""),
    "bureau_means": with_roles("view bureau balance", f"""
        SELECT target, {r('avg(active)', "avg_active_loans")}, {r('avg(overdue)', "avg_overdue_sum")},
          {r('avg(credit)', "avg_credit_sum")}, {r('avg(debt)', "avg_debt_sum")},
          {r('avg(coalesce(late, 0))', "avg_delinquent_months")}
        FROM view JOIN (SELECT "SK_ID_CURR", count(*) FILTER ("CREDIT_ACTIVE" = 'Active') AS active,
              sum("AMT_CREDIT_SUM_OVERDUE") AS overdue, sum("AMT_CREDIT_SUM") AS credit,
              sum("AMT_CREDIT_SUM_DEBT") AS debt FROM bureau GROUP BY 1) q ON "loanId" = q."SK_ID_CURR"
          LEFT JOIN (SELECT "SK_ID_CURR", count(*) FILTER ("STATUS" IN ('1','2','3','4','5')) AS late
            FROM bureau JOIN balance USING ("SK_ID_BUREAU") GROUP BY 1) h ON "loanId" = h."SK_ID_CURR"
        GROUP BY target"""),
    "history_means": with_roles("view bureau balance", f"""SELECT target, {r('avg(span)', 'avg_history_length', 6)},
        {r('avg(overall)', 'avg_status_score', 6)}, {r('avg(recent)', 'avg_recent_status', 6)}
        FROM hist GROUP BY 1""", hist=HISTORIES),
    "record_means": label_means("bureau", """avg("CREDIT_DAY_OVERDUE") AS days, max("AMT_CREDIT_MAX_OVERDUE") AS worst,
        avg("AMT_CREDIT_SUM_DEBT" / nullif("AMT_CREDIT_SUM_LIMIT", 0)) AS used""",
        avg_overdue_days="days", avg_max_overdue="worst", avg_utilization="used"),
    "installment_means": label_means("inst", """avg("DAYS_ENTRY_PAYMENT" - "DAYS_INSTALMENT") AS late_days,
        count(*) FILTER ("DAYS_ENTRY_PAYMENT" > "DAYS_INSTALMENT") / count(*) AS late_ratio,
        avg("AMT_PAYMENT" - "AMT_INSTALMENT") AS gap, avg("NUM_INSTALMENT_VERSION") AS version, count(*) AS n""",
        avg_late_days="late_days", avg_late_ratio="late_ratio", avg_payment_diff="gap", avg_version="version",
        avg_installment_count="n"),
    "underpaid_rate": with_roles("view inst", rate("inst_underpaid_freq", "joined"),
        joined=f'SELECT * FROM ({INST_RISK}) JOIN view USING ("loanId")'),
    "card_means": label_means("card", f"""avg({_USED}) AS used,
        avg({_USED}) FILTER ("MONTHS_BALANCE" = -1) AS recent""", avg_utilization="used", recent_utilization="recent"),
    "utilization_group": on_bureau(
        "CASE WHEN coalesce(\"AMT_CREDIT_SUM_LIMIT\", 0) <= 0 THEN 'Tidak ada limit' ELSE "
        + steps('"AMT_CREDIT_SUM_DEBT" / "AMT_CREDIT_SUM_LIMIT"', UTIL_BANDS,
                "Rendah (<30%)") + " END AS util_group"),
    "overdue_severity": on_bureau("CASE WHEN \"AMT_CREDIT_MAX_OVERDUE\" > 0 THEN 'Pernah tunggakan'"
                                  " ELSE 'Tanpa tunggakan' END AS overdue_severity"),
    "update_recency": on_bureau("CASE WHEN \"DAYS_CREDIT_UPDATE\" >= -30 THEN '≤ 30 hari'"
                                " ELSE '> 30 hari' END AS update_recency"),
    "rate_by_credit_type": on_bureau('"CREDIT_TYPE" AS "creditType"'),
    "rate_by_credit_status": on_bureau('"CREDIT_ACTIVE" AS "creditActive"'),
    "delinquent_category": on_histories(
        "CASE WHEN months >= 3 THEN '3+' ELSE months::VARCHAR END AS delinquent_category"),
    "trend_group": on_histories("CASE WHEN recent > overall THEN 'Memburuk' WHEN recent < overall"
                                " THEN 'Membaik' ELSE 'Stabil' END AS trend"),
    "history_group": on_histories(steps("span", [
        ("<= 6", "Pendek (≤6 bulan)"), ("<= 12", "Sedang (7-12 bulan)"), ("<= 24", "Panjang (13-24 bulan)")],
        "Sangat Panjang (>24 bulan)") + " AS history_length_group"),
    "composite_score": composite(False),
    "composite_score_log": composite(True),
    "debt_ratio_bucket": on_groups(
        "bureau", 'sum("AMT_CREDIT_SUM_DEBT") / nullif(any_value(v."incomeTotal"), 0) AS x',
        steps("x", [("< 1", "Ringan (<1x)"), ("< 3", "Sedang (1-3x)"), ("< 5", "Berat (3-5x)")],
              "Sangat Berat (>5x)") + " AS debt_ratio_bucket"),
    "active_ratio_bucket": on_groups(
        "bureau", "count(*) FILTER (\"CREDIT_ACTIVE\" = 'Active') / count(*) AS x",
        steps("x", [("<= 0.25", "0-25%"), ("<= 0.5", "25-50%"), ("<= 0.75", "50-75%")], ">75%")
        + " AS active_ratio_bucket"),
    "refusals_by_target": with_roles("view prev", """SELECT target, round(avg(n), 6) AS avg_refused_count
        FROM view JOIN (SELECT "SK_ID_CURR", count(*) FILTER ("NAME_CONTRACT_STATUS" = 'Refused') AS n
          FROM prev GROUP BY 1) q ON "loanId" = q."SK_ID_CURR" GROUP BY 1"""),
    "rate_by_reject_reason": on_rows("prev", "prev", '"CODE_REJECT_REASON" AS reject_reason'),
    "rate_by_decision_recency": on_rows("prev", "prev", "CASE WHEN \"DAYS_DECISION\" >= -30 THEN '≤ 30 hari'"
                                        " ELSE '> 30 hari' END AS decision_recency"),
    "remaining_bucket": on_rows("pos", "pos", steps('"CNT_INSTALMENT_FUTURE"', [
        ("<= 0", "0"), ("<= 6", "1-6"), ("<= 12", "7-12")], ">12") + " AS remaining_installment_bucket"),
    "pos_risk_profile": on_rows("pos", "pos", """CASE
        WHEN "CNT_INSTALMENT_FUTURE" > 12 AND "SK_DPD" > 0 THEN 'High Remaining + DPD'
        WHEN "CNT_INSTALMENT_FUTURE" > 12 THEN 'High Remaining' WHEN "SK_DPD" > 0 THEN 'DPD'
        ELSE 'Normal' END AS risk_profile"""),
    "late_bucket": on_groups("inst", INST_GROUPS, steps("late", [
        ("<= 0", "Tepat Waktu"), ("< 6", "Keterlambatan Ringan"), ("<= 15", "Keterlambatan Sedang")],
        "Keterlambatan Berat") + " AS late_bucket"),
    "payment_diff_bucket": on_groups("inst", INST_GROUPS, steps("gap", [
        ("< -500", "Kurang Bayar Berat"), ("< 0", "Kurang Bayar Ringan"), ("= 0", "Sesuai")],
        "Lebih Bayar") + " AS payment_diff_bucket"),
    "version_group": on_groups("inst", INST_GROUPS, steps("version", [
        ("= 0", "Versi 0"), ("= 1", "Versi 1")], "Versi 2+") + " AS max_version_group"),
    "card_utilization_bucket": on_groups("card", CARD_GROUPS, steps(
        "used", UTIL_BANDS, "Rendah (<30%)", "Tidak ada limit") + " AS utilization_bucket"),
    "pay_ratio_bucket": on_groups("card", CARD_GROUPS, """CASE
        WHEN coalesce(draw, 0) <= 0 THEN 'Tidak Ada Penarikan' WHEN pay IS NULL THEN 'Tidak ada data'
        WHEN pay / draw < 0.4e0 THEN 'Pembayaran Sangat Rendah'
        WHEN pay / draw < 1 THEN 'Pembayaran Sebagian' ELSE 'Pembayaran Penuh' END AS pay_ratio_bucket"""),
    "net_borrowing_bucket": on_groups("card", CARD_GROUPS, steps("borrowed", [
        ("<= 0", "Tidak Menambah Hutang"), ("< 100000", "Menambah Hutang Ringan")],
        "Menambah Hutang Berat") + " AS net_borrowing_bucket"),
}
