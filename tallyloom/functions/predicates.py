"""Conditions between a source and a target row, and the score of a fuzzy match."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.options import ReconOptions, ToleranceRule

#: Hundredths that a full tolerance of amount or date takes off the best fuzzy score.
AMOUNT_PENALTY, DATE_PENALTY = 15, 10
Divisibility = Callable[[Column, Column], Column]


def _dec(value, kind: str = "decimal(18,4)") -> Column:
    return F.lit(str(value)).cast(kind)


def same_payment(s_amount: Column, t_amount: Column, s_date: Column, t_date: Column) -> Column:
    """Equal amount and UTC date; reference and currency are the key of the bucket already."""
    return (s_amount == t_amount) & (s_date == t_date)


def amount_within(source: Column, target: Column, rule: ToleranceRule) -> Column:
    """Within the absolute tolerance, or within the percentage of the source; a source of zero has no percentage."""
    gap = F.abs(source - target)
    return (gap <= _dec(rule.absolute)) | ((source != 0) & (gap * 100 <= _dec(rule.percentage) * F.abs(source)))


def date_within(a: Column, b: Column, rule: ToleranceRule) -> Column:
    return F.abs(F.datediff(a, b)) <= rule.date_window_days


def money_within_percentage(a: Column, b: Column, percentage) -> Column:
    """Both zero: true; a zero: false; else the difference against a. There is no absolute tolerance here."""
    return F.when((a == 0) & (b == 0), True).when(a == 0, False).otherwise(F.abs(a - b) * 100 <= _dec(percentage) * F.abs(a))


def money_within_absolute(a: Column, b: Column, tolerance) -> Column:
    return F.abs(a - b) <= _dec(tolerance)


def divides_decimal(source: Column, part: Column) -> Column:
    return F.try_mod(source, part) == 0


def divides_scaled(source: Column, part: Column) -> Column:
    """The same on whole ten-thousandths, further decimals cut."""
    scale = lambda c: (c.cast("decimal(38,10)") * 10000).cast("bigint")
    return F.try_mod(scale(source), scale(part)) == 0


#: By the names of configuration; the mantissa variant gives the same results as the decimal one.
DIVISIBILITY: dict[str, Divisibility] = {"Decimal": divides_decimal, "ScaledLong": divides_scaled, "UnsafeMantissa": divides_decimal}


def partial_split(source: Column, target: Column, divides: Divisibility = divides_decimal) -> Column:
    """The target is a smaller part, not zero, that goes into the source evenly; signs and dates don't matter."""
    s, t = F.abs(source), F.abs(target)
    return F.coalesce((t != 0) & (t < s) & divides(s, t), F.lit(False))


@dataclass(frozen=True)
class FuzzyCost:
    """A fuzzy score in whole numbers, so every way of computing it orders targets alike.

    The score is fuzzy_max less cost / scale, and never below fuzzy_min. per_gap is the cost of a ten-thousandth of
    amount, per_day that of a day; gaps beyond most_gap and days beyond most_days cost no more, as the score is at its
    least by then.
    """

    per_gap: int
    per_day: int
    scale: int
    limit: int
    most_gap: int
    most_days: int

    @classmethod
    def of(cls, options: ReconOptions) -> FuzzyCost:
        absolute, window = int(options.tolerance.absolute * 10_000), options.tolerance.date_window_days
        a, w = max(absolute, 1), max(window, 1)
        scale = 100 * a * w
        limit = int((options.fuzzy_max - options.fuzzy_min) * scale)
        return cls(AMOUNT_PENALTY * w if absolute else 0, DATE_PENALTY * a if window else 0, scale, limit, 10 * a, 20 * w)


def fuzzy_cost(s_amount: Column, t_amount: Column, s_date: Column, t_date: Column, options: ReconOptions) -> Column:
    """bigint: what the differences of amount and date take off the score, at most the span of scores."""
    c = FuzzyCost.of(options)
    gap = F.least((F.abs(s_amount - t_amount).cast("decimal(20,4)") * 10_000).cast("decimal(28,0)"), F.lit(c.most_gap).cast("decimal(28,0)")).cast("bigint")
    days = F.least(F.abs(F.datediff(s_date, t_date)).cast("bigint"), F.lit(c.most_days).cast("bigint"))
    return F.least(gap * F.lit(c.per_gap).cast("bigint") + days * F.lit(c.per_day).cast("bigint"), F.lit(c.limit).cast("bigint"))


def fuzzy_score(s_amount: Column, t_amount: Column, s_date: Column, t_date: Column, options: ReconOptions) -> Column:
    """decimal(20,16): best, less the used parts of both tolerances, never below the least nor above the best."""
    c = FuzzyCost.of(options)
    used = fuzzy_cost(s_amount, t_amount, s_date, t_date, options).cast("decimal(20,0)") / F.lit(c.scale).cast("decimal(18,0)")
    return (_dec(options.fuzzy_max, "decimal(20,16)") - used.cast("decimal(20,16)")).cast("decimal(20,16)")
