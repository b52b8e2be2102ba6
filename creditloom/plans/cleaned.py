"""Cleaned copies of the history tables: default fills, then full-row distinct."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from creditloom.operators.cleaning import distinct_rows
from creditloom.operators.projection import fill_defaults
from creditloom.operators.sketches import distinct_of_mostly_unique
from creditloom.schemas import RAW_TABLES

UNKNOWN = "Unknown"

# Columns that keep their NULLs, and fills other than 0 and 'Unknown' (fixed values).
KEPT = {
    "bureau": ["SK_ID_CURR", "SK_ID_BUREAU", "CREDIT_ACTIVE", "CREDIT_CURRENCY"],
    "bureau_balance": ["SK_ID_BUREAU", "MONTHS_BALANCE"],
    "previous_application": ["SK_ID_PREV", "SK_ID_CURR"],
    "POS_CASH_balance": ["SK_ID_PREV", "SK_ID_CURR", "MONTHS_BALANCE"],
    "installments_payments": ["SK_ID_PREV", "SK_ID_CURR", "NUM_INSTALMENT_NUMBER"],
    "credit_card_balance": ["SK_ID_PREV", "SK_ID_CURR", "MONTHS_BALANCE"],
}
SPECIAL = {
    "bureau_balance": {"STATUS": "C"},
    "previous_application": {"FLAG_LAST_APPL_PER_CONTRACT": "N"},
}
# Tables with one row per record: the column whose values are counted before rows are compared.
RECORD_ID = {"bureau": "SK_ID_BUREAU", "previous_application": "SK_ID_PREV"}


def default_fills(table: str) -> dict[str, object]:
    """Fill per column: 0 for numbers, 'Unknown' for strings, with exceptions."""
    fills: dict[str, object] = {
        f.name: UNKNOWN if isinstance(f.dataType, T.StringType) else 0
        for f in RAW_TABLES[table].fields if f.name not in KEPT[table]}
    return fills | SPECIAL.get(table, {})


def clean_table(df: DataFrame, table: str, partial: bool = False, mostly_unique: bool = False) -> DataFrame:
    """Fill, then drop repeated rows; ``partial`` allows a frame with some of the columns.

    ``mostly_unique`` spares rows without a copy the exchange, at the price of a second read.
    Tables with one row per record are spared it by a read of the record id alone.
    """
    filled = fill_defaults(df, default_fills(table), partial)
    if mostly_unique:
        return distinct_of_mostly_unique(filled)
    record = RECORD_ID.get(table)
    return distinct_of_mostly_unique(filled, by=[record]) if record in filled.columns else distinct_rows(filled)
