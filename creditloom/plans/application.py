"""Application tables: cleaning, model features and the exploration view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.functions import (
    between_flag, cross_profile, days_to_years, flag, map_groups, ratio, score_conditions,
)
from creditloom.operators.cleaning import dedup_by_key, impute_mode, impute_numeric
from creditloom.operators.projection import columns_by_type, encode_flag, present, rename_project, sentinel

KEY, LABEL = "SK_ID_CURR", "TARGET"

# ---- fixed values -----------------------------------------------------------
NOT_EMPLOYED = 365243
TEN_YEARS = -3650
INCOME_GROUPS = {
    "Stable": ["State servant", "Pensioner"],
    "Private": ["Working", "Commercial associate"],
}
INCOME_DEFAULT = "Others/Rare"
OCCUPATION_GROUPS = {
    "High Risk": ["Low-skill Laborers", "Drivers", "Waiters/barmen staff", "Security staff",
                  "Laborers", "Cooking staff", "Cleaning staff"],
    "Medium Risk": ["Sales staff", "Realty agents", "Secretaries", "Private service staff",
                    "Core staff", "None"],
}
OCCUPATION_DEFAULT = "Low Risk"
ASSET_LABELS = {(1, 1): "Both", (1, 0): "Only Car", (0, 1): "Only House"}
ASSET_DEFAULT = "None"
COMMUTE_LABELS = {(0, 0): "Stabil", (0, 1): "Komuter Lokal", (1, 1): "Komuter Jauh"}
COMMUTE_DEFAULT = "Lainnya"

# Source columns the feature table needs; everything else is pruned at the scan.
FEATURE_SOURCES = [
    KEY, "NAME_CONTRACT_TYPE", "CODE_GENDER", "FLAG_OWN_CAR", "FLAG_OWN_REALTY", "CNT_CHILDREN",
    "AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", "AMT_GOODS_PRICE", "NAME_INCOME_TYPE",
    "DAYS_BIRTH", "DAYS_EMPLOYED", "DAYS_REGISTRATION", "DAYS_ID_PUBLISH", "OCCUPATION_TYPE",
    "CNT_FAM_MEMBERS", "REGION_RATING_CLIENT", "HOUR_APPR_PROCESS_START",
    "REG_REGION_NOT_LIVE_REGION", "REG_CITY_NOT_LIVE_CITY", "EXT_SOURCE_1", "EXT_SOURCE_2",
    "EXT_SOURCE_3", "DAYS_LAST_PHONE_CHANGE",
]


def clean_application(df: DataFrame, strategy: str = "approx_median", rel_err: float = 0.01,
                      age: str = "ageYears", age_digits: int = 0, employed: str = "yearsEmployed",
                      unemployed: str = "isUnemployed", fit_on: DataFrame | None = None,
                      dedup: bool = False, by: str | None = None) -> DataFrame:
    """Encode flags, turn day offsets into years and impute what is missing.

    Statistics are taken from ``fit_on`` (default: the frame itself, so each
    split imputes from its own values), in one pass for all values of the split
    column ``by`` if that is given. Imputed numeric columns are double.
    """
    def derive(raw: DataFrame) -> DataFrame:
        out = encode_flag(raw, ["FLAG_OWN_CAR", "FLAG_OWN_REALTY"])
        out = out.withColumn(age, days_to_years("DAYS_BIRTH", digits=age_digits))
        out = sentinel(out, "DAYS_EMPLOYED", NOT_EMPLOYED, 0.0,
                       days_to_years("DAYS_EMPLOYED", digits=2), unemployed, employed)
        return out.drop("DAYS_BIRTH", "DAYS_EMPLOYED")

    base = derive(df)
    reference = base if fit_on is None else derive(fit_on)
    numeric = columns_by_type(base, exclude=(LABEL, KEY, by))
    out = impute_numeric(base, numeric, strategy, rel_err, reference, by)
    out = impute_mode(out, columns_by_type(base, ("string",), exclude=(by,)), fit_on=reference, by=by)
    return dedup_by_key(out, [KEY], [c for c in out.columns if c != KEY]) if dedup else out


def application_features(df: DataFrame, with_target: bool = True, strategy: str = "approx_median",
                         rel_err: float = 0.01, fit_on: DataFrame | None = None) -> DataFrame:
    """One feature row per loan: 26 columns, 25 without the label."""
    needed = FEATURE_SOURCES + ([LABEL] if with_target else [])
    cleaned = clean_application(df.select(*needed), strategy, rel_err,
                                fit_on=None if fit_on is None else fit_on.select(*FEATURE_SOURCES))
    columns = feature_columns()
    if not with_target:
        columns.pop("target")
    return cleaned.select([c.alias(n) for n, c in columns.items()])


def application_features_of_splits(df: DataFrame, split: str, strategy: str = "approx_median",
                                   rel_err: float = 0.01) -> DataFrame:
    """Features of all splits in one frame, each imputed from its own values; 26 columns.

    ``split`` names a column of few values. The label of an unlabelled split is NULL.
    """
    cleaned = clean_application(df.select(*FEATURE_SOURCES, LABEL, split), strategy, rel_err, by=split)
    return cleaned.withColumn(LABEL, F.col(LABEL).cast("double")).select(
        [c.alias(n) for n, c in feature_columns().items()])


def feature_columns() -> dict[str, Column]:
    c = F.col
    return {
        "loanId": c(KEY),
        "target": F.col(LABEL),
        "ageYears": c("ageYears"),
        "gender": c("CODE_GENDER"),
        "has_car": c("FLAG_OWN_CAR"),
        "has_house": c("FLAG_OWN_REALTY"),
        "asset_profile": cross_profile("FLAG_OWN_CAR", "FLAG_OWN_REALTY", ASSET_LABELS,
                                       ASSET_DEFAULT),
        "children_cnt": c("CNT_CHILDREN"),
        "family_members": c("CNT_FAM_MEMBERS"),
        "income_per_member": ratio("AMT_INCOME_TOTAL", "CNT_FAM_MEMBERS"),
        "contract_type": c("NAME_CONTRACT_TYPE"),
        "credit_amt": c("AMT_CREDIT"),
        "annuity_amt": c("AMT_ANNUITY"),
        "debt_to_income": ratio("AMT_CREDIT", "AMT_INCOME_TOTAL"),
        "payment_to_income": ratio("AMT_ANNUITY", "AMT_INCOME_TOTAL"),
        "has_down_payment": flag(c("AMT_CREDIT") < c("AMT_GOODS_PRICE")),
        "income_type_group": map_groups("NAME_INCOME_TYPE", INCOME_GROUPS, INCOME_DEFAULT),
        "occupation_risk_group": occupation_risk("OCCUPATION_TYPE"),
        "stability_score": score_conditions(c("DAYS_REGISTRATION") <= TEN_YEARS,
                                            c("DAYS_ID_PUBLISH") <= TEN_YEARS),
        "commute_risk_profile": cross_profile("REG_REGION_NOT_LIVE_REGION",
                                              "REG_CITY_NOT_LIVE_CITY", COMMUTE_LABELS,
                                              COMMUTE_DEFAULT),
        "region_rate": c("REGION_RATING_CLIENT"),
        "is_dini_hari": between_flag("HOUR_APPR_PROCESS_START", 0, 5),
        "EXT_SOURCE_1": c("EXT_SOURCE_1"),
        "EXT_SOURCE_2": c("EXT_SOURCE_2"),
        "EXT_SOURCE_3": c("EXT_SOURCE_3"),
        "days_phone_change": c("DAYS_LAST_PHONE_CHANGE"),
    }


def occupation_risk(col: Column | str) -> Column:
    return map_groups(col, OCCUPATION_GROUPS, OCCUPATION_DEFAULT)


def application_clean(df: DataFrame, strategy: str = "approx_median", rel_err: float = 0.01) -> DataFrame:
    """The wide cleaned table: all source columns, two-digit years, one row per key."""
    return clean_application(df, strategy, rel_err, age="AGE_YEARS", age_digits=2,
                             employed="YEARS_EMPLOYED", unemployed="FLAG_UNEMPLOYED", dedup=True)


# ---- exploration view -------------------------------------------------------
# Analyst name of every source column, and of the three derived ones.
VIEW_NAMES = {
    "SK_ID_CURR": "loanId",
    "TARGET": "target",
    "NAME_CONTRACT_TYPE": "contractType",
    "CODE_GENDER": "gender",
    "FLAG_OWN_CAR": "ownCar",
    "FLAG_OWN_REALTY": "ownRealty",
    "CNT_CHILDREN": "childrenCnt",
    "AMT_INCOME_TOTAL": "incomeTotal",
    "AMT_CREDIT": "creditAmt",
    "AMT_ANNUITY": "annuityAmt",
    "AMT_GOODS_PRICE": "goodsPrice",
    "NAME_TYPE_SUITE": "suiteType",
    "NAME_INCOME_TYPE": "incomeType",
    "NAME_EDUCATION_TYPE": "education",
    "NAME_FAMILY_STATUS": "familyStatus",
    "NAME_HOUSING_TYPE": "housingType",
    "REGION_POPULATION_RELATIVE": "regionPop",
    "DAYS_REGISTRATION": "daysReg",
    "DAYS_ID_PUBLISH": "daysIdPub",
    "OWN_CAR_AGE": "carAge",
    "FLAG_MOBIL": "flagMobil",
    "FLAG_EMP_PHONE": "empPhone",
    "FLAG_WORK_PHONE": "workPhone",
    "FLAG_CONT_MOBILE": "contMobile",
    "FLAG_PHONE": "flagPhone",
    "FLAG_EMAIL": "flagEmail",
    "OCCUPATION_TYPE": "occupation",
    "CNT_FAM_MEMBERS": "famMembers",
    "REGION_RATING_CLIENT": "regionRate",
    "REGION_RATING_CLIENT_W_CITY": "regionRateCity",
    "WEEKDAY_APPR_PROCESS_START": "weekdayApp",
    "HOUR_APPR_PROCESS_START": "hourApp",
    "REG_REGION_NOT_LIVE_REGION": "regNotLive",
    "REG_REGION_NOT_WORK_REGION": "regNotWork",
    "LIVE_REGION_NOT_WORK_REGION": "liveNotWork",
    "REG_CITY_NOT_LIVE_CITY": "cityNotLive",
    "REG_CITY_NOT_WORK_CITY": "cityNotWork",
    "LIVE_CITY_NOT_WORK_CITY": "liveCityNotWork",
    "ORGANIZATION_TYPE": "orgType",
    "EXT_SOURCE_1": "ext1",
    "EXT_SOURCE_2": "ext2",
    "EXT_SOURCE_3": "ext3",
    "APARTMENTS_AVG": "avgApt",
    "BASEMENTAREA_AVG": "avgBsmt",
    "YEARS_BEGINEXPLUATATION_AVG": "avgYrsExpl",
    "YEARS_BUILD_AVG": "avgYrsBuild",
    "COMMONAREA_AVG": "avgCommArea",
    "ELEVATORS_AVG": "avgElev",
    "ENTRANCES_AVG": "avgEnt",
    "FLOORSMAX_AVG": "avgFlrMax",
    "FLOORSMIN_AVG": "avgFlrMin",
    "LANDAREA_AVG": "avgLand",
    "LIVINGAPARTMENTS_AVG": "avgLivApt",
    "LIVINGAREA_AVG": "avgLivArea",
    "NONLIVINGAPARTMENTS_AVG": "avgNonLivApt",
    "NONLIVINGAREA_AVG": "avgNonLivArea",
    "APARTMENTS_MODE": "modeApt",
    "BASEMENTAREA_MODE": "modeBsmt",
    "YEARS_BEGINEXPLUATATION_MODE": "modeYrsExpl",
    "YEARS_BUILD_MODE": "modeYrsBuild",
    "COMMONAREA_MODE": "modeCommArea",
    "ELEVATORS_MODE": "modeElev",
    "ENTRANCES_MODE": "modeEnt",
    "FLOORSMAX_MODE": "modeFlrMax",
    "FLOORSMIN_MODE": "modeFlrMin",
    "LANDAREA_MODE": "modeLand",
    "LIVINGAPARTMENTS_MODE": "modeLivApt",
    "LIVINGAREA_MODE": "modeLivArea",
    "NONLIVINGAPARTMENTS_MODE": "modeNonLivApt",
    "NONLIVINGAREA_MODE": "modeNonLivArea",
    "APARTMENTS_MEDI": "medApt",
    "BASEMENTAREA_MEDI": "medBsmt",
    "YEARS_BEGINEXPLUATATION_MEDI": "medYrsExpl",
    "YEARS_BUILD_MEDI": "medYrsBuild",
    "COMMONAREA_MEDI": "medCommArea",
    "ELEVATORS_MEDI": "medElev",
    "ENTRANCES_MEDI": "medEnt",
    "FLOORSMAX_MEDI": "medFlrMax",
    "FLOORSMIN_MEDI": "medFlrMin",
    "LANDAREA_MEDI": "medLand",
    "LIVINGAPARTMENTS_MEDI": "medLivApt",
    "LIVINGAREA_MEDI": "medLivArea",
    "NONLIVINGAPARTMENTS_MEDI": "medNonLivApt",
    "NONLIVINGAREA_MEDI": "medNonLivArea",
    "FONDKAPREMONT_MODE": "modeFond",
    "HOUSETYPE_MODE": "modeHouse",
    "TOTALAREA_MODE": "modeTotal",
    "WALLSMATERIAL_MODE": "modeWall",
    "EMERGENCYSTATE_MODE": "modeEmerg",
    "OBS_30_CNT_SOCIAL_CIRCLE": "obs30",
    "DEF_30_CNT_SOCIAL_CIRCLE": "def30",
    "OBS_60_CNT_SOCIAL_CIRCLE": "obs60",
    "DEF_60_CNT_SOCIAL_CIRCLE": "def60",
    "DAYS_LAST_PHONE_CHANGE": "daysPhone",
    "FLAG_DOCUMENT_2": "doc2",
    "FLAG_DOCUMENT_3": "doc3",
    "FLAG_DOCUMENT_4": "doc4",
    "FLAG_DOCUMENT_5": "doc5",
    "FLAG_DOCUMENT_6": "doc6",
    "FLAG_DOCUMENT_7": "doc7",
    "FLAG_DOCUMENT_8": "doc8",
    "FLAG_DOCUMENT_9": "doc9",
    "FLAG_DOCUMENT_10": "doc10",
    "FLAG_DOCUMENT_11": "doc11",
    "FLAG_DOCUMENT_12": "doc12",
    "FLAG_DOCUMENT_13": "doc13",
    "FLAG_DOCUMENT_14": "doc14",
    "FLAG_DOCUMENT_15": "doc15",
    "FLAG_DOCUMENT_16": "doc16",
    "FLAG_DOCUMENT_17": "doc17",
    "FLAG_DOCUMENT_18": "doc18",
    "FLAG_DOCUMENT_19": "doc19",
    "FLAG_DOCUMENT_20": "doc20",
    "FLAG_DOCUMENT_21": "doc21",
    "AMT_REQ_CREDIT_BUREAU_HOUR": "reqBurH",
    "AMT_REQ_CREDIT_BUREAU_DAY": "reqBurD",
    "AMT_REQ_CREDIT_BUREAU_WEEK": "reqBurW",
    "AMT_REQ_CREDIT_BUREAU_MON": "reqBurM",
    "AMT_REQ_CREDIT_BUREAU_QRT": "reqBurQ",
    "AMT_REQ_CREDIT_BUREAU_YEAR": "reqBurY",
    "ageYears": "ageYears",
    "yearsEmployed": "yearsEmployed",
    "isUnemployed": "isUnemployed",
}


def application_view(df: DataFrame, partial: bool = False) -> DataFrame:
    """Raw applications under analyst names; ``partial`` allows some of the source columns."""
    years = {"ageYears": days_to_years("DAYS_BIRTH", mode="floor"),
             "isUnemployed": flag(F.col("DAYS_EMPLOYED") == NOT_EMPLOYED),
             "yearsEmployed": F.when(F.col("DAYS_EMPLOYED") == NOT_EMPLOYED, 0.0).otherwise(
                 days_to_years("DAYS_EMPLOYED", digits=1))}
    derived = df.withColumns(years)
    return rename_project(derived, {c: VIEW_NAMES[c] for c in present(derived, list(VIEW_NAMES), partial)})
