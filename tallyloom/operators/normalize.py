"""Raw text rows into typed transactions, and the rows that can't be."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.enums import ErrorCode
from tallyloom.functions import scalar as S
from tallyloom.schemas import RAW, TXN

_FIELDS = {"reference": "Reference", "amount": "Amount", "currency": "Currency", "value_date": "ValueDate"}


def _error(message: Column, field: str | None) -> Column:
    return F.struct(F.lit(ErrorCode.INVALID_TRANSACTION.value).alias("code"), message.alias("message"), F.lit(field).cast("string").alias("field"))


def with_result(raw: DataFrame, side: str) -> DataFrame:
    """raw with every column of a transaction and error, null for a row that became one; the first failure is the error.

    Checked in this order: reference, amount, currency and value date blank; amount; value date; reference empty once
    stripped; currency not of three characters; amount beyond the type. A booking date that can't be read is null. The
    ordinal is the row number and orders the rows of one file; reconcile numbers those of several files anew.
    """
    ref, code = S.normalize_reference(F.col("reference")), S.currency_code(F.col("currency"))
    amount = S.normalize_amount(F.col("amount"))
    booked = F.when(~S.is_blank(F.col("booking_date")), S.parse_date(F.col("booking_date")))
    read = F.struct(ref.alias("ref"), code.alias("_code"), amount.alias("_amount"), S.parse_date(F.col("value_date")).alias("value_ts"), booked.alias("booking_ts"), S.parse_amount(F.col("amount")).alias("_parsed"))
    # Through a generator each text is read once: the optimizer would put the reading into every use of its result.
    df = raw.select("*", F.inline(F.array(read)))
    error = None
    for column, name in _FIELDS.items():
        blank, said = S.is_blank(F.col(column)), _error(F.lit(f"{name} is required."), name)
        error = F.when(blank, said) if error is None else error.when(blank, said)
    error = error.when(F.col("_parsed").isNull(), _error(F.concat(F.lit("Cannot parse amount '"), F.col("amount"), F.lit("'.")), "Amount"))
    error = error.when(F.col("value_ts").isNull(), _error(F.concat(F.lit("Cannot parse date '"), F.col("value_date"), F.lit("'.")), "ValueDate"))
    error = error.when(F.col("ref") == "", _error(F.lit("Normalization failed: reference is empty."), None))
    error = error.when(F.col("_code").isNull(), _error(F.lit("Normalization failed: currency has not three characters."), None))
    error = error.when(F.col("_amount").isNull(), _error(F.lit("Normalization failed: amount is too large."), None))
    return df.withColumns(
        {
            "error": error,
            "txn_id": S.transaction_id(F.lit(side), F.col("source_file"), F.col("row_number")),
            "side": F.lit(side),
            "ordinal": F.col("row_number").cast("bigint"),
            "description_norm": S.normalize_description(F.col("description")),
            "iban_norm": S.normalize_iban(F.col("iban")),
            "name_norm": S.wide_trim(F.col("counterparty_name")),
        }
    )


def normalize(raw: DataFrame, side: str = "S") -> tuple[DataFrame, DataFrame]:
    """(transactions, rejected rows with error_code, error_message, error_field, error_row); each row is in one of them."""
    done = with_result(raw, side)
    good = done.where(F.col("error").isNull()).select(
        "txn_id", "side", "ordinal", "ref", F.col("_code").alias("currency"), F.col("_amount").alias("amount"), "value_ts", S.utc_date(F.col("value_ts")).alias("value_date"),
        F.col("description_norm").alias("description"), F.col("iban_norm").alias("iban"), F.col("name_norm").alias("counterparty_name"), "booking_ts", "source_file", F.col("row_number").alias("source_row_number"),
    )
    bad = done.where(F.col("error").isNotNull()).select(*RAW.fieldNames(), F.col("error.code").alias("error_code"), F.col("error.message").alias("error_message"), F.col("error.field").alias("error_field"), F.col("row_number").alias("error_row"))
    return good.select(*TXN.fieldNames()), bad
