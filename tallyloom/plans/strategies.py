"""Matching strategies: whether a target will do for a source, in what order targets are preferred, and the score of the pair."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.enums import Strategy
from tallyloom.functions.predicates import DIVISIBILITY, Divisibility, amount_within, date_within, divides_decimal, fuzzy_cost, fuzzy_score, partial_split, same_payment
from tallyloom.options import ReconOptions


class MatchStrategy(Protocol):
    """A strategy as column functions of a source x and a target y, structs with amount, date and ordinal.

    eligible says whether y will do; preference, a number, orders eligible targets, the greatest first and the first in
    order of ordinals among equal ones; score is what the pair gets.
    """

    name: str

    def eligible(self, x: Column, y: Column, options: ReconOptions) -> Column: ...

    def preference(self, x: Column, y: Column, options: ReconOptions) -> Column: ...

    def score(self, x: Column, y: Column, options: ReconOptions) -> Column: ...


def _flat(value) -> Column:
    return F.lit(str(value)).cast("decimal(20,16)")


@dataclass(frozen=True)
class Exact:
    """Equal amount and date."""

    name: str = Strategy.EXACT.value

    def eligible(self, x: Column, y: Column, options: ReconOptions) -> Column:
        return same_payment(x["amount"], y["amount"], x["date"], y["date"])

    def preference(self, x: Column, y: Column, options: ReconOptions) -> Column:
        return F.lit(0)

    def score(self, x: Column, y: Column, options: ReconOptions) -> Column:
        return _flat(options.exact_confidence)


@dataclass(frozen=True)
class Fuzzy:
    """Amount and date within tolerance; the best unrounded score first, compared in whole numbers."""

    name: str = Strategy.FUZZY.value

    def eligible(self, x: Column, y: Column, options: ReconOptions) -> Column:
        return amount_within(x["amount"], y["amount"], options.tolerance) & date_within(x["date"], y["date"], options.tolerance)

    def preference(self, x: Column, y: Column, options: ReconOptions) -> Column:
        return -fuzzy_cost(x["amount"], y["amount"], x["date"], y["date"], options)

    def score(self, x: Column, y: Column, options: ReconOptions) -> Column:
        return fuzzy_score(x["amount"], y["amount"], x["date"], y["date"], options)


@dataclass(frozen=True)
class Partial:
    """A smaller amount that goes into the source's evenly; sums of several targets aren't tried."""

    divides: Divisibility = divides_decimal
    name: str = Strategy.PARTIAL.value

    def eligible(self, x: Column, y: Column, options: ReconOptions) -> Column:
        return partial_split(x["amount"], y["amount"], self.divides)

    def preference(self, x: Column, y: Column, options: ReconOptions) -> Column:
        return F.lit(0)

    def score(self, x: Column, y: Column, options: ReconOptions) -> Column:
        return _flat(options.partial_min)


def default_pipeline(divides: Divisibility = divides_decimal) -> list[MatchStrategy]:
    return [Exact(), Fuzzy(), Partial(divides)]


def pipeline_from_names(names: Sequence[str] | None, divisibility: str | None = None) -> list[MatchStrategy]:
    """Strategies by the names of configuration, in their order. Unknown names are skipped; if none is left, and for none given, the default stands. Unknown divisibility means the decimal one."""
    divides = DIVISIBILITY.get(divisibility or "", divides_decimal)
    made = {Strategy.EXACT.value: Exact(), Strategy.FUZZY.value: Fuzzy(), Strategy.PARTIAL.value: Partial(divides)}
    return [made[n] for n in names or () if n in made] or default_pipeline(divides)
