"""The gold table and the integrated table of the earlier generation."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from creditloom.operators.joins import fan_in
from creditloom.operators.projection import union_splits
from creditloom.plans import bureau as b
from creditloom.plans import cleaned, previous as p


def gold(app_train: DataFrame, app_test: DataFrame, bureau: DataFrame,
         previous: DataFrame) -> DataFrame:
    """Train and test applications with bureau and previous features: 65 columns.

    Inputs are the finished feature tables. Loans without history keep NULLs.
    """
    return fan_in(union_splits(app_train, app_test), [bureau, previous], "loanId")


def gold_from_raw(app_train: DataFrame, app_test: DataFrame, raw: Mapping[str, DataFrame],
                  variant: str = "as_coded") -> DataFrame:
    """The same table in one plan, when the feature tables are not wanted on disk.

    Only loans in the application table survive the left join, so the full
    outer merge of the previous features is not needed: each group joins the
    base directly and stays on the partitioning its aggregation produced.
    """
    return gold_in_one_plan(union_splits(app_train, app_test), raw, variant)


def gold_in_one_plan(applications: DataFrame, raw: Mapping[str, DataFrame], variant: str = "as_coded") -> DataFrame:
    """The gold table on the features of all splits."""
    parts = p.previous_parts(raw["previous_application"], raw["POS_CASH_balance"],
                             raw["installments_payments"], raw["credit_card_balance"], variant)
    tables = [b.bureau_features(raw["bureau"], raw["bureau_balance"], variant)]
    tables += [spec.table(detail) for spec, detail in parts]
    return fan_in(applications, tables, "loanId")


def integrate(base: DataFrame, features: list[DataFrame]) -> DataFrame:
    """Cleaned applications with the six feature tables of the earlier generation."""
    return fan_in(base, features, "SK_ID_CURR")


def integrated_features(raw: Mapping[str, DataFrame], partial: bool = False) -> list[DataFrame]:
    """The six feature tables, each from its cleaned raw table."""
    return list(features_from_cleaned(
        {n: cleaned.clean_table(raw[n], n, partial) for n in cleaned.KEPT}).values())


def features_from_cleaned(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    return {
        "bureau_credit_features": b.bureau_credit_features(tables["bureau"]),
        "bureau_delinquency_features": b.bureau_delinquency_features(
            tables["bureau"], tables["bureau_balance"]),
        "previous_application_features": p.previous_application_features(
            tables["previous_application"]),
        "pos_loan_features": p.pos_loan_features(tables["POS_CASH_balance"]),
        "installment_payment_features": p.installment_payment_features(
            tables["installments_payments"]),
        "credit_card_features": p.credit_card_features(tables["credit_card_balance"]),
    }
