"""Problem 1: differences between two copies of a dataset."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.amounts import read_amount
from tallyloom.functions.scalar import normalize_reference
from tallyloom.operators.timestamps import FEED, VALUE, InstantDictionary, feed_of, with_instants
from tallyloom.plans.shared import write_table

#: What a field's normaliser does: (rows, {column made: column read}) -> rows; all columns read are of the one field.
Normaliser = Callable[[DataFrame, dict[str, str]], DataFrame]


def marked(text: Column, value: Column) -> Column:
    """The value where there is one; else the text itself, marked as text; null for null."""
    return F.when(text.isNotNull(), F.coalesce(F.concat(F.lit("="), value), F.concat(F.lit("~"), text)))


def by_column(f: Callable[[Column], Column]) -> Normaliser:
    """A normaliser from a column function; where that gives null for a text, the text itself stands, marked as text."""
    return lambda df, columns: df.withColumns({made: marked(F.col(read), f(F.col(read)).cast("string")) for made, read in columns.items()})


def diff_copies(left: DataFrame, right: DataFrame, keys: list[str], fields: dict[str, Normaliser]) -> DataFrame:
    """Rows that one side lacks and fields that differ: keys, side ('left', 'right', 'both'), diffs.

    diffs is array<struct<field, left_value, right_value>> of the values as they stand, empty for a row that one side
    lacks. Keys are matched null-safely: null equals null. Values are equal if their normal forms are; null equals
    only null. A row that a side holds several times unchanged counts once; held with different values, each version
    is compared and each difference comes out once. Columns that aren't named don't matter. Empty tables give empty
    or one-sided results.

    Equal rows are folded on each side before the shuffle, so a key repeated without end costs one row a partition;
    normal forms are computed only for the rows whose raw values differ.
    """

    def side(df: DataFrame, mark: str) -> DataFrame:
        cols = [F.col(k).alias(f"_{mark}k{i}") for i, k in enumerate(keys)] + [F.col(f).alias(f"_{mark}_{f}") for f in fields]
        return df.select(*cols).distinct().withColumn(f"_{mark}", F.lit(True))

    a, b = side(left, "l"), side(right, "r")
    on = reduce(Column.__and__, [F.col(f"_lk{i}").eqNullSafe(F.col(f"_rk{i}")) for i in range(len(keys))])
    both = a.join(b, on, "full_outer")
    same = reduce(Column.__and__, [F.col(f"_l_{f}").eqNullSafe(F.col(f"_r_{f}")) for f in fields])
    at = F.when(F.col("_r").isNull(), "left").when(F.col("_l").isNull(), "right").otherwise("both")
    met = both.withColumn("side", at).where((F.col("side") != "both") | ~same)
    met = met.select("side", *[F.when(F.col("side") == "right", F.col(f"_rk{i}")).otherwise(F.col(f"_lk{i}")).alias(k) for i, k in enumerate(keys)], *[f"_l_{f}" for f in fields], *[f"_r_{f}" for f in fields])
    for f, add in fields.items():
        met = add(met, {f"_ln_{f}": f"_l_{f}", f"_rn_{f}": f"_r_{f}"})
    entries = [F.when((F.col("side") == "both") & ~F.col(f"_ln_{f}").eqNullSafe(F.col(f"_rn_{f}")), F.struct(F.lit(f).alias("field"), F.col(f"_l_{f}").cast("string").alias("left_value"), F.col(f"_r_{f}").cast("string").alias("right_value"))) for f in fields]
    out = met.select(*keys, "side", F.filter(F.array(*entries), lambda x: x.isNotNull()).alias("diffs"))
    return out.where((F.col("side") != "both") | (F.size("diffs") > 0)).distinct()


def instant_normaliser(feed_info: DataFrame, zone_label: DataFrame, source_file: str, path: str | None = None) -> Normaliser:
    """Dates and times in normal form, by the feed that source_file names, each distinct text of a feed read once."""
    dictionary = InstantDictionary(feed_info, zone_label, path)

    def add(df: DataFrame, columns: dict[str, str]) -> DataFrame:
        rows = write_table(df.withColumn(FEED, feed_of(F.col(source_file))), "differing-rows")
        texts = rows.select(FEED, F.explode(F.array(*map(F.col, columns.values()))).alias(VALUE))
        known = dictionary.update(texts)
        for made, read in columns.items():
            rows = with_instants(rows, read, known, "_norm", F.struct(*rows.columns)).withColumn(made, marked(F.col(read), F.col("_norm"))).drop("_norm")
        return rows.drop(FEED)

    return add


def reason_form(text: Column) -> Column:
    """Without case, white space and underscores."""
    return F.lower(F.regexp_replace(text, r"(?U)[\s_]+", ""))


def case_rows(diffs: DataFrame, tab: str, row_number: str) -> DataFrame:
    """diff_copies over (source_file, row_number) as one row a difference: tab, source_file, row_number, diff."""
    names = F.when(F.col("side") == "left", F.array(F.lit("missing_in_copy"))).when(F.col("side") == "right", F.array(F.lit("missing_in_main"))).otherwise(F.transform("diffs", lambda d: d["field"]))
    return diffs.select(F.lit(tab).alias("tab"), "source_file", F.col(row_number).alias("row_number"), F.explode(names).alias("diff")).distinct()


def field_rows(diffs: DataFrame, tab: str, row_number: str) -> DataFrame:
    """diff_copies over (source_file, row_number) with one row a field: tab, source_file, row_number, side, field, left_value, right_value; field is null for a row that one side lacks."""
    one = F.explode_outer("diffs").alias("d")
    return diffs.select(F.lit(tab).alias("tab"), "source_file", F.col(row_number).alias("row_number"), "side", one).select("tab", "source_file", "row_number", "side", "d.field", "d.left_value", "d.right_value")


def _ledger_diffs(raw: DataFrame, raw_copy: DataFrame, unmatched: DataFrame, unmatched_copy: DataFrame, feed_info: DataFrame, zone_label: DataFrame, path: str | None) -> tuple[DataFrame, DataFrame]:
    of_raw = diff_copies(
        raw,
        raw_copy,
        ["source_file", "row_number"],
        {"reference": by_column(normalize_reference), "amount": by_column(read_amount), "value_date": instant_normaliser(feed_info, zone_label, "source_file", path)},
    )
    return of_raw, diff_copies(unmatched, unmatched_copy, ["source_file", "source_row_number"], {"reason": by_column(reason_form)})


def ledger_differences(raw: DataFrame, raw_copy: DataFrame, unmatched: DataFrame, unmatched_copy: DataFrame, feed_info: DataFrame, zone_label: DataFrame, path: str | None = None) -> DataFrame:
    """Differences between the two systems' raw transactions and unmatched transactions, one row each; path keeps the dictionary of dates."""
    of_raw, of_unmatched = _ledger_diffs(raw, raw_copy, unmatched, unmatched_copy, feed_info, zone_label, path)
    return case_rows(of_raw, "raw_txn", "row_number").unionByName(case_rows(of_unmatched, "unmatched", "source_row_number"))


def ledger_field_differences(raw: DataFrame, raw_copy: DataFrame, unmatched: DataFrame, unmatched_copy: DataFrame, feed_info: DataFrame, zone_label: DataFrame, path: str | None = None) -> DataFrame:
    """The same differences with the values of both sides as they stand."""
    of_raw, of_unmatched = _ledger_diffs(raw, raw_copy, unmatched, unmatched_copy, feed_info, zone_label, path)
    return field_rows(of_raw, "raw_txn", "row_number").unionByName(field_rows(of_unmatched, "unmatched", "source_row_number"))
