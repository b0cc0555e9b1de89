"""Settings of matching, checked when made."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from decimal import Decimal
from typing import Any


def _dec(value: Any) -> Decimal:
    return value if isinstance(value, Decimal) else Decimal(str(value))


@dataclass(frozen=True)
class ToleranceRule:
    """Amounts may differ by absolute, or by percentage of the source amount; dates by date_window_days."""

    absolute: Decimal = Decimal("5.00")
    percentage: Decimal = Decimal("0.50")
    date_window_days: int = 3

    def __post_init__(self) -> None:
        object.__setattr__(self, "absolute", _dec(self.absolute))
        object.__setattr__(self, "percentage", _dec(self.percentage))
        if self.absolute < 0:
            raise ValueError("absolute must be at least 0")
        if not 0 <= self.percentage <= 100:
            raise ValueError("percentage must lie between 0 and 100")
        if self.date_window_days < 0:
            raise ValueError("date_window_days must be at least 0")

    @classmethod
    def strict(cls) -> ToleranceRule:
        return cls(Decimal(0), Decimal(0), 0)

    @classmethod
    def standard(cls) -> ToleranceRule:
        return cls(Decimal("0.01"), Decimal("0.5"), 2)

    @classmethod
    def lenient(cls) -> ToleranceRule:
        return cls(Decimal("0.05"), Decimal(1), 5)


@dataclass(frozen=True)
class ReconOptions:
    """Confidences and tolerance; the defaults are those of production. Changing one: with_(name=value)."""

    exact_confidence: Decimal = Decimal("1.00")
    fuzzy_max: Decimal = Decimal("0.95")
    fuzzy_min: Decimal = Decimal("0.70")
    partial_min: Decimal = Decimal("0.60")
    tolerance: ToleranceRule = field(default_factory=ToleranceRule)

    def __post_init__(self) -> None:
        for name in ("exact_confidence", "fuzzy_max", "fuzzy_min", "partial_min"):
            object.__setattr__(self, name, _dec(getattr(self, name)))
        if not 0 <= self.exact_confidence <= 1:
            raise ValueError("exact_confidence must lie between 0 and 1")
        if self.fuzzy_min < 0 or self.fuzzy_max > 1 or self.fuzzy_min >= self.fuzzy_max:
            raise ValueError("fuzzy_min must be at least 0, fuzzy_max at most 1, and fuzzy_min below fuzzy_max")
        if not 0 <= self.partial_min <= 1:
            raise ValueError("partial_min must lie between 0 and 1")

    @classmethod
    def domain_defaults(cls) -> ReconOptions:
        """The other set of defaults: fuzzy up to 0.99, partial from 0.50, standard tolerance."""
        return cls(Decimal("1.0"), Decimal("0.99"), Decimal("0.70"), Decimal("0.50"), ToleranceRule.standard())

    @classmethod
    def from_dict(cls, conf: Mapping[str, Any]) -> ReconOptions:
        """From configuration keys; missing ones have their defaults, unknown ones don't matter."""
        base, rule = cls(), ToleranceRule()
        told = conf.get("Tolerance") or {}
        return cls(
            conf.get("ExactMatchConfidence", base.exact_confidence),
            conf.get("FuzzyMatchMaxConfidence", base.fuzzy_max),
            conf.get("FuzzyMatchMinConfidence", base.fuzzy_min),
            conf.get("PartialMatchMinConfidence", base.partial_min),
            ToleranceRule(told.get("AbsoluteTolerance", rule.absolute), told.get("PercentageTolerance", rule.percentage), int(told.get("DateWindowDays", rule.date_window_days))),
        )

    def with_(self, **changes: Any) -> ReconOptions:
        return replace(self, **changes)

    def with_tolerance(self, **changes: Any) -> ReconOptions:
        """Another tolerance. What isn't named goes back to its default and isn't kept from this tolerance."""
        return replace(self, tolerance=ToleranceRule(**changes))

    @classmethod
    def draft(cls, start: ReconOptions | None = None) -> OptionsDraft:
        """Settings to be changed step by step, from the defaults or another set; build() checks them."""
        return OptionsDraft(start or cls())


class OptionsDraft:
    """Settings in the making: each step gives another draft, and nothing is checked before build()."""

    def __init__(self, start: ReconOptions, changes: Mapping[str, Any] | None = None, rule: Mapping[str, Any] | None = None):
        self._start, self._changes, self._rule = start, dict(changes or {}), rule

    def _and(self, **changes: Any) -> OptionsDraft:
        return OptionsDraft(self._start, self._changes | changes, self._rule)

    def exact(self, confidence: Any) -> OptionsDraft:
        return self._and(exact_confidence=confidence)

    def fuzzy(self, least: Any, most: Any) -> OptionsDraft:
        return self._and(fuzzy_min=least, fuzzy_max=most)

    def partial(self, confidence: Any) -> OptionsDraft:
        return self._and(partial_min=confidence)

    def tolerance(self, **values: Any) -> OptionsDraft:
        """absolute, percentage, date_window_days; what isn't named goes back to its default."""
        return OptionsDraft(self._start, self._changes, values)

    def build(self) -> ReconOptions:
        rule = self._start.tolerance if self._rule is None else ToleranceRule(**self._rule)
        return replace(self._start, tolerance=rule, **self._changes)
