"""Amount texts as numbers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digits with at most one decimal mark before two decimals; the other mark groups digits by three.
BODY = r"(?:\d+|\d+[.,]\d{2}|\d{1,3}(?:,\d{3})+\.\d{2}|\d{1,3}(?:\.\d{3})+,\d{2})"
WHOLE = rf"^(?:\(\s*{BODY}\s*\)|-\s*{BODY}|{BODY}\s*-|{BODY})$"
#: Fixed value: the characters that Unicode calls white space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def wide_trim(text: Column) -> Column:
    """Without white space of any kind at either end (trim only knows the blank)."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def short_key(text: Column, longest: int = 64) -> Column:
    """A key of bounded length for the trimmed text: itself, or its hash if it has more than longest characters."""
    return let(wide_trim(text), lambda t: F.when(F.length(t) <= longest, t).otherwise(F.concat(F.lit("\u0001"), F.sha2(t, 256))))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def read_amount(text: Column) -> Column:
    """decimal(38,2), or null for null and for texts that are no amount.

    The last of point and comma is the decimal mark and has two decimals behind it; the other groups digits by
    three; parentheses, or a minus at one end, make it negative. Numbers beyond 36 digits are null.
    """

    def number(t: Column) -> Column:
        digits = F.regexp_replace(t, r"[^0-9]", "")
        scaled = F.when(t.rlike(r"[.,]"), F.regexp_replace(digits, r"(\d{2})$", ".$1")).otherwise(digits)
        signed = F.when(t.rlike(r"[-(]"), F.concat(F.lit("-"), scaled)).otherwise(scaled)
        return F.when(t.rlike(WHOLE), signed.try_cast("decimal(38,2)"))

    return let(wide_trim(text), number)
