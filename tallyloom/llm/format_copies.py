"""Problem 3: records that differ in formatting only, collapsed into one with a count of its copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.amounts import read_amount
from tallyloom.plans.shared import write_table

#: Keys with at least this part of all rows are hot; there are at most as many of them, so their broadcast is bounded (20,000 keys of 16 bytes).
MOST_HOT = 20_000
#: Sub-groups into which a hot key's rows are spread.
SALTS = 256


def letters_and_digits(text: Column) -> Column:
    """Lower case letters, marks and digits of a text; null for null."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{M}\p{N}]+", ""))


def description_form(text: Column) -> Column:
    """Like letters_and_digits, but labelled fields (a word, then a value, at least one value with a digit) are sorted."""
    words = F.trim(F.lower(F.regexp_replace(text, r"[^\p{L}\p{M}\p{N}]+", " ")))
    labelled = F.regexp_like(words, F.lit(r"\d")) & F.regexp_like(words, F.lit(r"^\p{L}+ [\p{L}\p{M}\p{N}]+(?: \p{L}+ [\p{L}\p{M}\p{N}]+)*+$"))
    fields = F.array_join(F.array_sort(F.regexp_extract_all(words, F.lit(r"(\p{L}+ [\p{L}\p{M}\p{N}]+)"), F.lit(1))), ";")
    return F.when(labelled, fields).otherwise(F.replace(words, F.lit(" "), F.lit("")))


def digest(parts: list[Column]) -> Column:
    """128 bits of SHA-256 over the parts; null differs from every text, and no text can shift into its neighbour."""
    framed = [F.coalesce(F.concat(F.length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts]
    return F.substring(F.unhex(F.sha2(F.concat(*framed), 256)), 1, 16)


def record_keys(raw: DataFrame) -> DataFrame:
    """raw_id and the key of its record; rows without a readable amount or without raw_id are left out."""
    amount = read_amount(F.col("amount"))
    form = [letters_and_digits(F.col(c)) for c in ("reference", "currency", "iban", "counterparty_name")]
    key = digest([*form, description_form(F.col("description")), amount.cast("string"), F.col("value_date"), F.col("booking_date")])
    return raw.where(amount.isNotNull() & F.col("raw_id").isNotNull()).select("raw_id", key.alias("key"))


def grouped_copies(keys: DataFrame, id_col: str = "raw_id") -> DataFrame:
    """id, first (the smallest id with the same key) and copies (rows with it) for every row of keys (id, key).

    Counts per key are made exactly, from counts within each partition. Keys that hold a MOST_HOT-th of all rows go
    through two levels: smallest id and count per key and salt, then per key; the result, one row per hot key, goes
    to the rows by broadcast. All other keys go through one shuffle, in groups of less than a MOST_HOT-th of the rows. A
    row that occurs twice under one id counts twice. An empty table gives an empty result.
    """
    keys = write_table(keys, "record-keys")
    total = keys.count()
    hot = write_table(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(3.0, total / MOST_HOT)).select("key"), "hot-keys")
    hot_rows = keys.join(F.broadcast(hot), "key", "left_semi")
    salted = hot_rows.groupBy("key", F.pmod(F.xxhash64(id_col), F.lit(SALTS)).alias("salt")).agg(F.min(id_col).alias("first"), F.count(F.lit(1)).alias("copies"))
    firsts = salted.groupBy("key").agg(F.min("first").alias("first"), F.sum("copies").alias("copies"))
    of_hot = keys.join(F.broadcast(firsts), "key").select(id_col, "first", "copies")
    cold = keys.join(F.broadcast(hot), "key", "left_anti")
    group = Window.partitionBy("key")
    of_cold = cold.select(id_col, F.min(id_col).over(group).alias("first"), F.count(F.lit(1)).over(group).alias("copies"))
    return of_hot.unionByName(of_cold)


def record_copies(raw: DataFrame) -> DataFrame:
    """first_raw_id, raw_id for each further copy of a record."""
    found = grouped_copies(record_keys(raw))
    return found.where(F.col("raw_id") > F.col("first")).select(F.col("first").alias("first_raw_id"), "raw_id")


def records(raw: DataFrame) -> DataFrame:
    """One row per record: the smallest raw_id and the number of its copies, itself included."""
    found = grouped_copies(record_keys(raw))
    return found.where(F.col("raw_id") == F.col("first")).select(F.col("first").alias("first_raw_id"), "copies").distinct()
