"""Column functions of the normaliser: references, amounts, dates and text fields of raw transactions.

Upper case is that of Spark, which writes some letters as two; all functions keep null. Times without a zone are UTC,
and days are those of UTC, whatever the session's time zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions.amounts import let, wide_trim

NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d{1,2})?$"
ZONE = r"(?: ?(?:Z|UTC|GMT|[+-]\d{2}(?::?\d{2})?))?"
TIME = rf"(?:[T ]\d{{1,2}}:\d{{2}}(?::\d{{2}}(?:\.\d{{1,9}})?)?{ZONE})?"
#: A date that starts with the year, one that doesn't, and one of eight digits.
YEAR_FIRST = rf"^(\d{{4}})[-/](\d{{1,2}})[-/](\d{{1,2}})({TIME})$"
YEAR_LAST = rf"^(\d{{1,2}})([/.-])(\d{{1,2}})\2(\d{{4}})({TIME})$"
COMPACT = r"^(\d{4})(\d{2})(\d{2})$"
#: Forms with words, by Spark's patterns.
WORDED = r"(?i)(?:[AP]M$|^(?:[A-Z]{3}, )?\d{1,2} [A-Z]{3} \d{4}|^[A-Z]{3} \d{1,2}, \d{4})"
WORDED_FORMS = ("M/d/yyyy h:mm:ss a", "d MMM yyyy", "MMM d, yyyy", "d MMM yyyy HH:mm:ss Z")


def is_blank(text: Column) -> Column:
    return F.coalesce(wide_trim(text), F.lit("")) == ""


def normalize_reference(text: Column) -> Column:
    """Trimmed, without blanks, hyphens and slashes, upper case; text of those alone becomes ''."""
    return F.upper(F.translate(wide_trim(text), " -/", ""))


def parse_amount(text: Column) -> Column:
    """decimal(38,10), or null if the text is no number.

    If the last comma stands behind the last point, commas are decimal marks and points go; otherwise commas go. A lone
    comma is thus always a decimal mark, and of two no number is made. Parentheses and a minus behind negate; the
    sign ¤, an exponent and a plus are allowed.
    """

    def number(t: Column) -> Column:
        marked = F.when(t.rlike(r",[^.]*$"), F.translate(t, ",.", ".")).otherwise(F.translate(t, ",", ""))
        signed = F.regexp_replace(F.regexp_replace(marked, r"^\(\s*([^()+-]*?)\s*\)$", "-$1"), r"^([^+-]*?)\s*-$", "-$1")
        return let(signed, lambda x: F.when(x.rlike(NUMBER), x.try_cast("decimal(38,10)")))

    return let(F.regexp_replace(wide_trim(text), r"\s*¤\s*", ""), number)


def round_money(value: Column) -> Column:
    """decimal(18,2), halves away from zero; null beyond 16 digits before the point."""
    return F.round(value, 2).try_cast("decimal(18,2)")


def normalize_amount(text: Column) -> Column:
    return round_money(parse_amount(text))


def parse_date(text: Column) -> Column:
    """timestamp, or null. Year first, with or without time and offset; month first where the first number can be a month, else day first; eight digits; a few forms with words."""

    def iso(t: Column) -> Column:
        first, second = F.regexp_extract(t, YEAR_LAST, 1), F.regexp_extract(t, YEAR_LAST, 3)
        month_day = F.when(first.try_cast("int") <= 12, F.concat(first, F.lit("-"), second)).otherwise(F.concat(second, F.lit("-"), first))
        turned = F.concat(F.regexp_extract(t, YEAR_LAST, 4), F.lit("-"), month_day, F.regexp_extract(t, YEAR_LAST, 5))
        return F.when(t.rlike(YEAR_FIRST), F.regexp_replace(t, YEAR_FIRST, "$1-$2-$3$4")).when(t.rlike(YEAR_LAST), turned).when(t.rlike(COMPACT), F.regexp_replace(t, COMPACT, "$1-$2-$3"))

    def cast(x: Column) -> Column:
        full = F.regexp_replace(x, r"([ T]\d{1,2}:\d{2})(?![:\d])", "$1:00")
        offset = F.regexp_replace(F.regexp_replace(full, r"(:\d{2}(?:\.\d+)? ?[+-]\d{2})(\d{2})$", "$1:$2"), r"(:\d{2}(?:\.\d+)? ?[+-]\d{2})$", "$1:00")
        zoned = F.when(offset.rlike(r":\d{2}.*(?:Z|UTC|GMT|[+-]\d{2}:\d{2})$"), offset).otherwise(F.concat(offset, F.when(offset.contains(":"), "Z").otherwise(" 00:00:00Z")))
        return zoned.try_cast("timestamp")

    def worded(t: Column) -> Column:
        plain = F.regexp_replace(t, r"^[A-Za-z]{3}, ", "")
        return F.when(t.rlike(WORDED), F.coalesce(*[F.try_to_timestamp(plain, F.lit(f)) if f.endswith("Z") else F.try_to_timestamp(F.concat(plain, F.lit(" +0000")), F.lit(f"{f} Z")) for f in WORDED_FORMS]))

    return let(wide_trim(text), lambda t: let(iso(t), lambda x: F.when(x.isNotNull(), cast(x)).otherwise(worded(t))))


def normalize_description(text: Column) -> Column:
    """Trimmed and upper case; '' for null."""
    return F.upper(wide_trim(F.coalesce(text, F.lit(""))))


def normalize_iban(text: Column) -> Column:
    """Trimmed; if blanks are inside, those go and the rest becomes upper case, else the case stays as it is."""
    t = wide_trim(text)
    return F.when(F.contains(t, F.lit(" ")), F.upper(F.replace(t, F.lit(" "), F.lit("")))).otherwise(t)


def currency_code(text: Column) -> Column:
    """Trimmed and upper case; null unless three characters are left. No list of currencies is asked."""
    t = F.upper(wide_trim(text))
    return F.when(F.length(t) == 3, t)


def utc_date(ts: Column) -> Column:
    return F.date_from_unix_date(F.floor(F.unix_micros(ts) / F.lit(86_400_000_000)).cast("int"))


def money(amount: Column, currency: Column) -> Column:
    """amount (two decimals) and currency as a struct; a currency that hasn't three characters is an error, null is null."""
    code = currency_code(currency)
    made = F.struct(round_money(amount).alias("amount"), code.alias("currency"))
    return F.when(amount.isNull() | currency.isNull(), None).when(code.isNotNull(), made).otherwise(F.raise_error(F.lit("a currency has three characters")).cast("struct<amount:decimal(18,2),currency:string>"))


def minor_units(amount: Column) -> Column:
    """bigint of ten-thousandths; an amount with more than four decimals is an error."""
    scaled = amount.cast("decimal(38,10)") * 10000
    return F.when(scaled == F.floor(scaled), scaled.cast("bigint")).otherwise(F.when(amount.isNotNull(), F.raise_error(F.lit("more than four decimals")).cast("bigint")))


def from_minor_units(units: Column) -> Column:
    return (units.cast("decimal(24,0)") / F.lit(10000).cast("decimal(5,0)")).cast("decimal(22,4)")


def add_money(a: Column, currency_a: Column, b: Column, currency_b: Column) -> Column:
    """The sum of two amounts of one currency; different currencies are an error."""
    return F.when(currency_a == currency_b, round_money(a + b)).otherwise(F.raise_error(F.lit("different currencies")).cast("decimal(18,2)"))


def subtract_money(a: Column, currency_a: Column, b: Column, currency_b: Column) -> Column:
    return add_money(a, currency_a, -b, currency_b)


def confidence(value: Column) -> Column:
    """decimal(5,4), halves away from zero; outside 0 to 1 is an error."""
    return F.when(value.between(0, 1), F.round(value.cast("decimal(20,10)"), 4).cast("decimal(5,4)")).otherwise(F.when(value.isNotNull(), F.raise_error(F.lit("confidence outside 0 to 1")).cast("decimal(5,4)")))


def confidence_band(score: Column) -> Column:
    """'High' from 0.90, 'Medium' from 0.70, else 'Low'."""
    return F.when(score >= 0.90, "High").when(score >= 0.70, "Medium").when(score.isNotNull(), "Low")


def transaction_id(side: Column, source_file: Column, row_number: Column) -> Column:
    """The same for the same row on every run."""
    return F.sha2(F.concat_ws("\u0001", side, F.coalesce(source_file, F.lit("")), F.coalesce(row_number.cast("string"), F.lit(""))), 256)


def valid_transaction_id(text: Column) -> Column:
    """A UUID that isn't all zeros, or one of the ids made here."""
    uuid = F.lower(text).rlike(r"^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$") & ~text.rlike(r"^[0-]+$")
    return F.coalesce(uuid | text.rlike(r"^[0-9a-f]{64}$"), F.lit(False))
