"""Feature definitions on small hand-written rows."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditloom import schemas
from creditloom.plans import application as a, bureau as b, gold as g, previous as p


def table(spark, schema, *records):
    """Rows given as dicts; missing columns are NULL."""
    def value(field, record):
        v = record.get(field.name)
        return float(v) if v is not None and isinstance(field.dataType, T.DoubleType) else v
    return spark.createDataFrame([tuple(value(f, r) for f in schema.fields) for r in records], schema)


def by_key(df, key="loanId"):
    return {r[key]: r.asDict() for r in df.collect()}


BUREAU = [
    # loan 1: one record with four balance months, one without any
    dict(SK_ID_CURR=1, SK_ID_BUREAU=10, CREDIT_ACTIVE="Active", AMT_CREDIT_SUM_OVERDUE=5,
         AMT_CREDIT_SUM_LIMIT=100, AMT_CREDIT_SUM_DEBT=80, CREDIT_TYPE="Microloan", DAYS_CREDIT_UPDATE=-30,
         AMT_CREDIT_MAX_OVERDUE=1),
    dict(SK_ID_CURR=1, SK_ID_BUREAU=11, CREDIT_ACTIVE="Closed", AMT_CREDIT_SUM_OVERDUE=7,
         AMT_CREDIT_SUM_LIMIT=0, AMT_CREDIT_SUM_DEBT=50, CREDIT_TYPE="Mortgage", DAYS_CREDIT_UPDATE=-31),
    # loan 2: only a bad debt
    dict(SK_ID_CURR=2, SK_ID_BUREAU=20, CREDIT_ACTIVE="Bad debt", CREDIT_TYPE="Credit card",
         AMT_CREDIT_MAX_OVERDUE=0),
    # loan 3: sold, with letters only
    dict(SK_ID_CURR=3, SK_ID_BUREAU=30, CREDIT_ACTIVE="Sold", AMT_CREDIT_SUM_OVERDUE=0),
]
BALANCE = [
    dict(SK_ID_BUREAU=10, MONTHS_BALANCE=0, STATUS="2"), dict(SK_ID_BUREAU=10, MONTHS_BALANCE=-3, STATUS="5"),
    dict(SK_ID_BUREAU=10, MONTHS_BALANCE=-4, STATUS="0"), dict(SK_ID_BUREAU=10, MONTHS_BALANCE=-60, STATUS=None),
    dict(SK_ID_BUREAU=30, MONTHS_BALANCE=-1, STATUS="C"), dict(SK_ID_BUREAU=30, MONTHS_BALANCE=-2, STATUS="X"),
    dict(SK_ID_BUREAU=99, MONTHS_BALANCE=-2, STATUS="5"),
]


@pytest.fixture
def bureau(spark):
    return table(spark, schemas.BUREAU, *BUREAU), table(spark, schemas.BUREAU_BALANCE, *BALANCE)


def test_bureau_as_coded_counts_the_fan_out(bureau):
    got = by_key(b.bureau_features(*bureau))
    one = got[1]
    assert (one["active_loan_count"], one["closed_bureau_loans"], one["sold_bureau_loans"]) == (4, 1, 0)
    assert one["overdueSum"] == 4 * 5 + 7
    assert one["is_high_utilization"] == 0            # (4 * 0.8 + 0) / 5 = 0.64
    assert (one["delinquent_months"], one["ever_delinquent"], one["ever_status_5"]) == (2, 1, 1)
    assert (one["history_length"], one["is_worsening_trend"], one["all_closed"]) == (60, 0, 0)
    assert (one["is_microloan"], one["has_collateral_loan"], one["is_recent_update"]) == (1, 1, 1)
    assert got[2]["all_closed"] == 1                  # neither sold nor active
    assert (got[2]["history_length"], got[2]["overdueSum"], got[2]["ever_overdue"]) == (None, None, 0)
    assert (got[3]["has_sold"], got[3]["delinquent_months"], got[3]["history_length"]) == (1, 0, 1)
    assert len(one) == 21


def test_bureau_intended_counts_each_record_once(bureau):
    got = by_key(b.bureau_features(*bureau, "intended"))
    one = got[1]
    assert (one["active_loan_count"], one["closed_bureau_loans"], one["overdueSum"]) == (1, 1, 12.0)
    assert one["is_high_utilization"] == 1            # 0.8 over the one record with a limit
    assert one["is_worsening_trend"] == 1             # 3.5 over two recent months, 1.75 over four
    assert got[2]["all_closed"] == 0
    with pytest.raises(ValueError):
        b.bureau_spec("other")


def test_bureau_summary_equals_joining_out_a_hot_record(spark, rows):
    """A third of all balance rows belong to one record, and record keys repeat."""
    records = spark.range(60).selectExpr(
        "id % 7 AS SK_ID_CURR", "id % 50 AS SK_ID_BUREAU",
        "element_at(array('Active', 'Closed', 'Sold', 'Bad debt'), CAST(id % 4 + 1 AS INT)) AS CREDIT_ACTIVE",
        "CAST(id AS DOUBLE) AS AMT_CREDIT_SUM_OVERDUE", "CAST(id % 3 * 8 AS DOUBLE) AS AMT_CREDIT_SUM_LIMIT",
        "CAST(id % 5 AS DOUBLE) AS AMT_CREDIT_SUM_DEBT")
    balance = spark.range(900).selectExpr(
        "IF(id % 3 = 0, 4, id % 61) AS SK_ID_BUREAU", "CAST(-(id % 97) AS INT) AS MONTHS_BALANCE",
        "element_at(array('C', '0', '1', '5', 'X'), CAST(id % 5 + 1 AS INT)) AS STATUS")
    full = spark.createDataFrame([], schemas.BUREAU).unionByName(records, allowMissingColumns=True)
    got = b.bureau_features(full, balance).select(
        "loanId", "active_loan_count", "overdueSum", "delinquent_months", "history_length",
        "is_high_utilization")
    joined = records.join(balance, "SK_ID_BUREAU", "left")
    late = F.col("STATUS").isin("1", "2", "3", "4", "5")
    want = joined.groupBy("SK_ID_CURR").agg(
        F.count_if(F.col("CREDIT_ACTIVE") == "Active"), F.sum("AMT_CREDIT_SUM_OVERDUE"), F.count_if(late),
        F.max("MONTHS_BALANCE") - F.min("MONTHS_BALANCE"),
        F.when(F.avg(F.when(F.col("AMT_CREDIT_SUM_LIMIT") > 0, F.try_divide(
            "AMT_CREDIT_SUM_DEBT", "AMT_CREDIT_SUM_LIMIT")).otherwise(0.0)) > 0.7, 1).otherwise(0))
    assert rows(got) == rows(want)


def test_previous_and_pos(spark):
    prev = table(spark, schemas.PREVIOUS_APPLICATION,
                 dict(SK_ID_CURR=1, NAME_CONTRACT_STATUS="Refused", CODE_REJECT_REASON="SCOFR", DAYS_DECISION=-31),
                 dict(SK_ID_CURR=1, NAME_CONTRACT_STATUS="Refused", CODE_REJECT_REASON="XAP", DAYS_DECISION=-30),
                 dict(SK_ID_CURR=2, NAME_CONTRACT_STATUS="Approved", DAYS_DECISION=-31))
    got = by_key(p.previous_risk(prev))
    assert got[1] == dict(loanId=1, has_refused_prev=1, refused_count=2, is_high_risk_reason=1,
                          is_recent_decision=1)
    assert got[2] == dict(loanId=2, has_refused_prev=0, refused_count=0, is_high_risk_reason=0,
                          is_recent_decision=0)
    pos = table(spark, schemas.POS_CASH_BALANCE,
                dict(SK_ID_CURR=1, MONTHS_BALANCE=-1, CNT_INSTALMENT_FUTURE=13, SK_DPD=0),
                dict(SK_ID_CURR=1, MONTHS_BALANCE=-25, CNT_INSTALMENT_FUTURE=12, SK_DPD=1),
                dict(SK_ID_CURR=2, MONTHS_BALANCE=-1, CNT_INSTALMENT_FUTURE=13, SK_DPD=1),
                dict(SK_ID_CURR=2, MONTHS_BALANCE=-26, SK_DPD=None))
    got = by_key(p.pos_risk(pos))
    assert got[1] == dict(loanId=1, has_pos_dpd=1, is_pos_high_risk=0, pos_history_length=24,
                          is_pos_long_history=0)
    assert got[2] == dict(loanId=2, has_pos_dpd=1, is_pos_high_risk=1, pos_history_length=25,
                          is_pos_long_history=1)


@pytest.mark.parametrize("days,medium", [([6], 1), ([15], 1), ([15, 16], 0), ([5], 0), ([None], 0)])
def test_medium_late_bounds(spark, days, medium):
    inst = table(spark, schemas.INSTALLMENTS_PAYMENTS, *[
        dict(SK_ID_CURR=1, DAYS_INSTALMENT=0, DAYS_ENTRY_PAYMENT=d, AMT_INSTALMENT=1, AMT_PAYMENT=1,
             NUM_INSTALMENT_VERSION=1) for d in days])
    assert by_key(p.installment_risk(inst))[1]["is_inst_medium_late"] == medium


def test_underpaid_frequency_bounds(spark):
    shares = {1: 0, 2: 1, 3: 2, 4: 3, 5: 4}           # of ten instalments
    inst = table(spark, schemas.INSTALLMENTS_PAYMENTS, *[
        dict(SK_ID_CURR=loan, DAYS_INSTALMENT=0, DAYS_ENTRY_PAYMENT=0 if i else 1, AMT_INSTALMENT=10,
             AMT_PAYMENT=9 if i < short else 10, NUM_INSTALMENT_VERSION=0 if loan == 1 else 2)
        for loan, short in shares.items() for i in range(10)])
    got = by_key(p.installment_risk(inst))
    assert [got[k]["inst_underpaid_freq"] for k in shares] == [
        "Tidak Pernah", "Jarang", "Sedang", "Sedang", "Sering"]
    assert got[2]["inst_late_ratio"] == 0.1
    assert (got[1]["is_inst_version_0"], got[2]["is_inst_version_0"]) == (1, 0)
    assert got[3]["inst_avg_payment_diff"] == pytest.approx(-0.2)


CARD = [
    dict(SK_ID_CURR=1, MONTHS_BALANCE=-1, AMT_BALANCE=90, AMT_CREDIT_LIMIT_ACTUAL=100,
         AMT_DRAWINGS_CURRENT=10, AMT_PAYMENT_CURRENT=3),
    dict(SK_ID_CURR=1, MONTHS_BALANCE=-2, AMT_BALANCE=10, AMT_CREDIT_LIMIT_ACTUAL=100,
         AMT_DRAWINGS_CURRENT=0, AMT_PAYMENT_CURRENT=0),
    dict(SK_ID_CURR=1, MONTHS_BALANCE=-3, AMT_BALANCE=10, AMT_CREDIT_LIMIT_ACTUAL=0),
    dict(SK_ID_CURR=2, MONTHS_BALANCE=-2, AMT_BALANCE=10, AMT_CREDIT_LIMIT_ACTUAL=0,
         AMT_DRAWINGS_CURRENT=200000, AMT_PAYMENT_CURRENT=100000),
]


def test_card_risk(spark):
    card = table(spark, schemas.CREDIT_CARD_BALANCE, *CARD)
    got = by_key(p.card_risk(card))
    assert got[1]["cc_avg_utilization"] == pytest.approx(0.5)
    assert (got[1]["is_cc_high_utilization"], got[1]["cc_recent_utilization"]) == (1, 0.9)
    assert (got[1]["is_cc_low_pay_ratio"], got[1]["has_cc_activity"], got[1]["is_cc_accruing_debt"]) == (1, 1, 1)
    assert (got[2]["cc_avg_utilization"], got[2]["cc_recent_utilization"]) == (None, None)
    assert (got[2]["is_cc_low_pay_ratio"], got[2]["is_cc_accruing_debt"]) == (0, 0)   # net 100000 is extreme
    assert by_key(p.card_risk(card, "intended"))[1]["is_cc_high_utilization"] == 0
    with pytest.raises(ValueError):
        p.card_spec("other")


def test_previous_features_forms_agree(spark, rows):
    prev = table(spark, schemas.PREVIOUS_APPLICATION, dict(SK_ID_CURR=1, NAME_CONTRACT_STATUS="Refused"))
    pos = table(spark, schemas.POS_CASH_BALANCE, dict(SK_ID_CURR=2, MONTHS_BALANCE=-1, SK_DPD=1))
    inst = table(spark, schemas.INSTALLMENTS_PAYMENTS, dict(SK_ID_CURR=3, AMT_INSTALMENT=2, AMT_PAYMENT=1))
    card = table(spark, schemas.CREDIT_CARD_BALANCE, *CARD)
    union = p.previous_features(prev, pos, inst, card)
    join = p.previous_features(prev, pos, inst, card, form="join")
    assert rows(union) == rows(join) and union.columns == join.columns and len(union.columns) == 20
    got = by_key(union)
    assert set(got) == {1, 2, 3}
    assert got[3]["inst_underpaid_freq"] == "Sering" and got[3]["has_pos_dpd"] is None
    assert got[2]["inst_underpaid_freq"] is None, "no default label without instalments"


APP = dict(NAME_CONTRACT_TYPE="Cash loans", CODE_GENDER="F", FLAG_OWN_CAR="Y", FLAG_OWN_REALTY="N",
           CNT_CHILDREN=0, CNT_FAM_MEMBERS=2, AMT_INCOME_TOTAL=100, AMT_CREDIT=400, AMT_ANNUITY=20,
           AMT_GOODS_PRICE=500, DAYS_BIRTH=-10957, DAYS_EMPLOYED=-365, DAYS_REGISTRATION=-3650,
           DAYS_ID_PUBLISH=-3649, NAME_INCOME_TYPE="Working", OCCUPATION_TYPE="Drivers",
           REG_REGION_NOT_LIVE_REGION=0, REG_CITY_NOT_LIVE_CITY=1, REGION_RATING_CLIENT=2,
           HOUR_APPR_PROCESS_START=5, EXT_SOURCE_1=0.5, EXT_SOURCE_2=0.25, DAYS_LAST_PHONE_CHANGE=-1)


def applications(spark, *changes, schema=schemas.APPLICATION_TRAIN):
    return table(spark, schema, *[APP | dict(SK_ID_CURR=i + 1, TARGET=i % 2) | c
                                  for i, c in enumerate(changes)])


def test_application_features(spark):
    got = by_key(a.application_features(applications(
        spark, {}, {"FLAG_OWN_CAR": None, "FLAG_OWN_REALTY": "N", "CNT_FAM_MEMBERS": 0,
                    "AMT_INCOME_TOTAL": 0, "HOUR_APPR_PROCESS_START": 6, "DAYS_ID_PUBLISH": -3650,
                    "DAYS_EMPLOYED": 365243, "NAME_INCOME_TYPE": "Student", "OCCUPATION_TYPE": None},
        {"AMT_GOODS_PRICE": None, "OCCUPATION_TYPE": None, "NAME_INCOME_TYPE": "Pensioner",
         "REG_REGION_NOT_LIVE_REGION": 1, "REG_CITY_NOT_LIVE_CITY": 0})))
    one, two, three = got[1], got[2], got[3]
    assert len(one) == 26
    assert (one["ageYears"], one["asset_profile"], one["has_down_payment"]) == (30.0, "Only Car", 1)
    assert (one["income_per_member"], one["debt_to_income"], one["payment_to_income"]) == (50.0, 4.0, 0.2)
    assert (one["stability_score"], two["stability_score"]) == (1, 2)
    assert (one["commute_risk_profile"], three["commute_risk_profile"]) == ("Komuter Lokal", "Lainnya")
    assert (one["is_dini_hari"], two["is_dini_hari"]) == (1, 0)
    assert (two["income_per_member"], two["debt_to_income"]) == (0.0, 0.0)
    assert (two["asset_profile"], two["income_type_group"]) == ("None", "Others/Rare")
    # NULL is the most frequent occupation, so it becomes 'Unknown', which is in no risk group
    assert (one["occupation_risk_group"], two["occupation_risk_group"]) == ("High Risk", "Low Risk")
    assert three["income_type_group"] == "Stable"
    assert three["has_down_payment"] == 1              # price imputed with the median, 500
    assert three["EXT_SOURCE_3"] is None               # a column without values stays empty


def test_test_split_has_no_target_and_its_own_statistics(spark):
    test = applications(spark, {"AMT_ANNUITY": None}, {"AMT_ANNUITY": 1000}, schema=schemas.APPLICATION_TEST)
    got = a.application_features(test, with_target=False)
    assert len(got.columns) == 25 and "target" not in got.columns
    assert by_key(got)[1]["annuity_amt"] == 1000.0
    train = applications(spark, {}, {})
    assert by_key(a.application_features(test, False, fit_on=train))[1]["annuity_amt"] == 20.0


def test_gold_layouts_agree_and_keep_unlabelled_loans(spark, rows):
    train = a.application_features(applications(spark, {}, {}))
    test = a.application_features(applications(spark, {"SK_ID_CURR": 9}, schema=schemas.APPLICATION_TEST), False)
    raw = {"bureau": table(spark, schemas.BUREAU, *BUREAU),
           "bureau_balance": table(spark, schemas.BUREAU_BALANCE, *BALANCE),
           "previous_application": table(spark, schemas.PREVIOUS_APPLICATION,
                                         dict(SK_ID_CURR=1, NAME_CONTRACT_STATUS="Refused")),
           "POS_CASH_balance": table(spark, schemas.POS_CASH_BALANCE, dict(SK_ID_CURR=7, MONTHS_BALANCE=-1)),
           "installments_payments": table(spark, schemas.INSTALLMENTS_PAYMENTS, dict(SK_ID_CURR=2, AMT_PAYMENT=1)),
           "credit_card_balance": table(spark, schemas.CREDIT_CARD_BALANCE, *CARD)}
    fused = g.gold_from_raw(train, test, raw)
    layered = g.gold(train, test, b.bureau_features(raw["bureau"], raw["bureau_balance"]),
                     p.previous_features(raw["previous_application"], raw["POS_CASH_balance"],
                                         raw["installments_payments"], raw["credit_card_balance"]))
    assert len(layered.columns) == 65 and layered.columns == fused.columns
    assert rows(fused) == rows(layered)
    got = by_key(layered)
    assert set(got) == {1, 2, 9}
    assert (got[9]["target"], got[9]["has_sold"], got[9]["refused_count"]) == (None, None, None)
    assert dict(layered.dtypes)["target"] == "double"


def test_wide_clean_table(spark):
    df = applications(spark, {}, {"SK_ID_CURR": 1, "AMT_CREDIT": 1}, {"DAYS_EMPLOYED": 365243})
    got = by_key(a.application_clean(df), "SK_ID_CURR")
    assert set(got) == {1, 3}
    assert (got[1]["AGE_YEARS"], got[1]["YEARS_EMPLOYED"], got[3]["FLAG_UNEMPLOYED"]) == (30.0, 1.0, 1.0)
    assert got[3]["YEARS_EMPLOYED"] == 0.0 and "DAYS_BIRTH" not in got[1]


def test_application_view_names_every_column(spark):
    names = a.VIEW_NAMES
    assert len(names) == 123 and len(set(names.values())) == 123
    view = a.application_view(applications(spark, {"DAYS_EMPLOYED": 365243}))
    assert set(view.columns) == set(names.values())
    row = view.first()
    assert (row.ageYears, row.yearsEmployed, row.isUnemployed) == (29, 0.0, 1)
