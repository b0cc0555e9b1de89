"""Schemas of raw rows, transactions, pairs and reports."""

from __future__ import annotations

from pyspark.sql import types as T

RAW = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("reference", "amount", "currency", "value_date", "description", "iban", "counterparty_name", "booking_date")]
    + [T.StructField("row_number", T.IntegerType()), T.StructField("source_file", T.StringType())]
)
MONEY = T.DecimalType(18, 2)
SCORE = T.DecimalType(5, 4)
TXN = T.StructType(
    [
        T.StructField("txn_id", T.StringType()),
        T.StructField("side", T.StringType()),
        T.StructField("ordinal", T.LongType()),
        T.StructField("ref", T.StringType()),
        T.StructField("currency", T.StringType()),
        T.StructField("amount", MONEY),
        T.StructField("value_ts", T.TimestampType()),
        T.StructField("value_date", T.DateType()),
        T.StructField("description", T.StringType()),
        T.StructField("iban", T.StringType()),
        T.StructField("counterparty_name", T.StringType()),
        T.StructField("booking_ts", T.TimestampType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("source_row_number", T.IntegerType()),
    ]
)
PAIR_COLUMNS = ["ref", "currency", "s_id", "t_id", "s_ordinal", "t_ordinal", "s_amount", "t_amount", "s_date", "t_date", "strategy", "score"]
