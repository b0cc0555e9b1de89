"""Problem 5: lines that fail to parse, kept apart from the rows that load."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.amounts import read_amount, short_key
from tallyloom.functions.instants import label_map, moment_form
from tallyloom.operators.timestamps import FEED, feed_of, one_per_feed
from tallyloom.plans.shared import lookup, spread, write_table

FIELDS = ["reference", "amount", "currency", "value_date", "description", "iban", "counterparty_name", "booking_date"]
#: Cuts joined fields apart; where a line holds it, or the sign that masks it, both are masked.
CUT, MASK = "\u0001", "\u0002"
_KIND, _VALUE = "_column_feed", "_key"


def split_line(line: Column, delimiter: Column) -> Column:
    """The fields of a delimited line, null if its quoting is broken.

    A field may stand in double quotes, which are doubled inside it; only then may it hold delimiters or line breaks.
    Cut at the quotes, the pieces lie outside and inside them by turns. An empty inner piece outside is a doubled
    quote; every other must begin and end with the delimiter, and no piece outside may hold a line break. The
    delimiter is one character other than U+0001 and U+0002. Text of any length is cut without recursion.
    """

    def fields(pieces: Column) -> Column:
        n = F.size(pieces)
        inner_ok = lambda x, i: (i % 2 == 1) | (((i == 0) | (x == "") | x.startswith(delimiter)) & ((i == n - 1) | (x == "") | x.endswith(delimiter)) & ~x.rlike(r"[\r\n]"))
        # At the line's ends an empty piece means a field that begins or ends with its quote.
        sound = (n % 2 == 1) & F.forall(F.transform(pieces, inner_ok), lambda ok: ok)
        outside = lambda x: F.call_function("translate", x, delimiter, F.lit(CUT))
        joined = F.array_join(F.transform(pieces, lambda x, i: F.when(i % 2 == 1, x).when((x == "") & (i > 0) & (i < n - 1), F.lit('"')).otherwise(outside(x))), "")
        return F.when(sound, F.split(joined, CUT, -1))

    # As a variable of a lambda the pieces are cut once and not for each of them.
    cut = lambda text: F.transform(F.array(F.split(text, '"', -1)), fields)[0]
    masked = F.replace(F.replace(line, F.lit(MASK), F.lit(MASK + "b")), F.lit(CUT), F.lit(MASK + "a"))
    plain = lambda x: F.replace(F.replace(x, F.lit(MASK + "a"), F.lit(CUT)), F.lit(MASK + "b"), F.lit(MASK))
    return F.when(line.rlike(f"[{CUT}{MASK}]"), F.transform(cut(masked), plain)).otherwise(cut(line))


def parse_lines(raw_line: DataFrame, feed_info: DataFrame) -> DataFrame:
    """line_id, source_file, row_number, feed and the fields as an array; null where the structure is broken.

    Lines of feeds that feed_info lacks, and null lines, have no structure.
    """
    feeds = one_per_feed(feed_info, "delimiter")
    lines = raw_line.select("line_id", "source_file", "row_number", "line", feed_of(F.col("source_file")).alias(FEED)).join(feeds, FEED, "left")
    lines = lines.withColumn("_f", F.when((F.length("_delimiter") == 1) & ~F.col("_delimiter").isin(CUT, MASK), split_line(F.col("line"), F.col("_delimiter"))))
    return lines.withColumn("_f", F.when(F.size("_f") == len(FIELDS), F.col("_f"))).drop("line", "_delimiter")


def load_lines(raw_line: DataFrame, feed_info: DataFrame, zone_label: DataFrame) -> DataFrame:
    """Every line with its fields, its amount (decimal) and value date (normal form), and reason: null if it loads.

    reason is 'MalformedRow' (not eight fields of the feed's delimiter, or broken quoting), else 'InvalidAmount' (empty
    or no number), else 'InvalidDate' (empty, or no real full day, with a real time if one is given). A local time
    that its zone skips or repeats is a real time of a real day, so it loads, with a null value_at. Other fields
    are taken as they are. Lines are cut once, and each distinct amount, and each distinct date of a feed, is read once;
    white space at their ends doesn't tell them apart.
    """
    lines = write_table(parse_lines(spread(raw_line), feed_info), "parsed-lines")
    entry = lambda kind, i: F.struct(F.lit(kind).alias("c"), F.col("_f")[i].alias("v"))
    texts = lines.where(F.col("_f").isNotNull()).select(FEED, "_date_order", "_tz_name", F.explode(F.array(entry("amount", 1), entry("value_date", 3))).alias("_e"))
    is_amount = F.col(_KIND) == "amount"
    texts = texts.select(F.when(F.col("_e.c") == "amount", "amount").otherwise(F.concat_ws(":", F.lit("value_date"), FEED)).alias(_KIND), short_key(F.col("_e.v")).alias(_VALUE), F.col("_e.v").alias("_text"), "_date_order", "_tz_name")
    distinct = texts.groupBy(_KIND, _VALUE).agg(F.count(F.lit(1)).alias("n"), *[F.min(c).alias(c) for c in ("_text", "_date_order", "_tz_name")])
    read = distinct.withColumn("_m", moment_form(F.when(~is_amount, F.col("_text")), F.col("_date_order"), F.col("_tz_name"), label_map(zone_label)))
    amount = F.when(is_amount, read_amount(F.col("_text")))
    reason = F.when(is_amount & amount.isNull(), "InvalidAmount").when(~is_amount & ~F.col("_m.real"), "InvalidDate")
    dictionary = write_table(read.select(_KIND, _VALUE, "n", amount.alias("_amount"), F.col("_m.norm").alias("_at"), reason.alias("_reason")), "line-values")
    amounts, dates = dictionary.where(is_amount), dictionary.where(~is_amount)
    rows = lines.withColumn(_VALUE, short_key(F.col("_f")[1]))
    rows = lookup(rows, amounts, [_VALUE], ["_amount", "_reason"], F.col("line_id")).withColumnRenamed("_reason", "_bad_amount")
    rows = rows.withColumn(_KIND, F.concat_ws(":", F.lit("value_date"), FEED)).withColumn(_VALUE, short_key(F.col("_f")[3]))
    rows = lookup(rows, dates, [_KIND, _VALUE], ["_at", "_reason"], F.col("line_id"))
    why = F.when(F.col("_f").isNull(), "MalformedRow").otherwise(F.coalesce("_bad_amount", "_reason"))
    fields = [F.col("_f")[i].alias(f) for i, f in enumerate(FIELDS)]
    return rows.select("line_id", "source_file", "row_number", *fields, F.when(why.isNull(), F.col("_amount")).alias("amount_value"), F.when(why.isNull(), F.col("_at")).alias("value_at"), why.alias("reason"))


def loaded_rows(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("reason").isNull()).drop("reason")


def row_errors(lines: DataFrame) -> DataFrame:
    """line_id, source_file, row_number and reason of the lines that don't load."""
    return lines.where(F.col("reason").isNotNull()).select("line_id", "source_file", "row_number", "reason")
