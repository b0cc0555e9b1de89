"""Sources taking turns over arrays of targets, for groups of rows within a task."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal
from itertools import islice

import numpy as np
import pandas as pd

from tallyloom.functions.predicates import FuzzyCost
from tallyloom.options import ReconOptions
from tallyloom.plans.strategies import Exact, Fuzzy, MatchStrategy, Partial

#: Stand for a null ordinal, which comes last, and for a null date.
LAST, NO_DAY = np.iinfo("int64").max, -(10**9)
#: Cents beyond this are compared as Python's whole numbers.
WIDE_CENTS = 10**11


def cents_of(amounts: pd.Series) -> list[int | None]:
    return [None if pd.isna(a) else int(a * 100) for a in amounts]


def days_of(dates: pd.Series) -> np.ndarray:
    days = pd.to_datetime(dates).to_numpy().astype("datetime64[D]")
    return np.where(np.isnat(days), NO_DAY, days.astype("int64"))


def score_of(name: str, cost: int, options: ReconOptions) -> Decimal:
    """Four decimals, halves up."""
    if name == Exact().name:
        value = options.exact_confidence
    elif name == Partial().name:
        value = options.partial_min
    else:
        value = max(options.fuzzy_min, options.fuzzy_max - Decimal(cost) / Decimal(FuzzyCost.of(options).scale))
    return (value * 10_000 + Decimal("0.5")).to_integral_value("ROUND_FLOOR") / Decimal(10_000)


class Pool:
    """Targets that one group of sources may see, in order; cents and days are whole numbers."""

    def __init__(self, ordinals: np.ndarray, ids: np.ndarray, cents: list[int | None], days: np.ndarray, held: list[tuple[int, object] | None] | None = None):
        order = sorted(range(len(ids)), key=lambda i: (ordinals[i], ids[i]))
        known = [cents[i] for i in order]
        wide = any(c is not None and abs(c) > WIDE_CENTS for c in known)
        self.ids = [ids[i] for i in order]
        self.has = np.array([c is not None for c in known], bool)
        self.cents = np.array([c or 0 for c in known], object if wide else "int64")
        self.size = np.abs(self.cents)
        self.days = days[order] if len(order) else np.zeros(0, "int64")
        self.dated = self.has & (self.days != NO_DAY)
        self.rows = order
        self.held = [held[i] for i in order] if held else None
        self.holders = np.array([h[0] if h else LAST for h in self.held], "int64") if held else None
        self.any_held = np.array([h is not None for h in self.held], bool) if held else None
        self.exact: dict[tuple[int, int], list[int]] = {}
        for k, (c, d, ok) in enumerate(zip(known, self.days.tolist(), self.dated.tolist(), strict=True)):
            if ok:
                self.exact.setdefault((c, d), []).append(k)

    def open_to(self, ordinal: int, who: object) -> np.ndarray | None:
        """Which targets no earlier source of another group holds; None for all."""
        if self.held is None or not self.any_held.any():
            return None
        ok = ~self.any_held | (self.holders > ordinal)
        for k in np.flatnonzero(self.any_held & (self.holders == ordinal)):
            ok[k] = self.held[k][1] >= who
        return ok


def take_turns(sources: list[tuple], pools: dict[object, Pool], pipeline: Sequence[MatchStrategy], options: ReconOptions) -> list[tuple[int, object, int, str, int]]:
    """(source, pool, place in the pool, strategy, cost) for the sources that find a target.

    sources are (number, pool, ordinal, id, cents, day), in any order; they take turns in order of ordinal and id. A
    target that stands in several pools is claimed in all of them.
    """
    rule, price = options.tolerance, FuzzyCost.of(options)
    absolute, percentage = int(rule.absolute * 10_000), int(rule.percentage * 10_000)
    taken: set[object] = set()
    starts: dict[tuple, int] = {}
    free = {key: np.ones(len(p.ids), bool) for key, p in pools.items()}
    places: dict[object, list[tuple[object, int]]] = {}
    for key, p in pools.items():
        for k, x in enumerate(p.ids):
            places.setdefault(x, []).append((key, k))
    found = []
    for number, key, ordinal, who, cents, day in sorted(sources, key=lambda s: (s[2], s[3])):
        if key not in pools or cents is None:
            continue
        p = pools[key]
        allowed = p.open_to(ordinal, who)
        for s in pipeline:
            hit, cost = None, 0
            if isinstance(s, Exact):
                if day != NO_DAY:
                    same = p.exact.get((cents, day), [])
                    first = starts.get((key, cents, day), 0)
                    while first < len(same) and p.ids[same[first]] in taken:
                        first += 1
                    starts[key, cents, day] = first
                    if allowed is None:
                        hit = same[first] if first < len(same) else None
                    else:
                        hit = next((k for k in islice(same, first, None) if allowed[k] and p.ids[k] not in taken), None)
            elif isinstance(s, Fuzzy):
                if day != NO_DAY:
                    gap, off = np.abs(p.cents - cents) * 100, np.abs(p.days - day)
                    ok = free[key] & p.dated & (off <= rule.date_window_days) & ((gap <= absolute) | (gap * 10_000 <= percentage * abs(cents)) if cents else gap <= absolute)
                    at = np.flatnonzero(ok if allowed is None else ok & allowed)
                    if len(at):
                        costs = np.minimum(np.minimum(gap[at], price.most_gap) * price.per_gap + np.minimum(off[at], price.most_days) * price.per_day, price.limit)
                        k = int(costs.argmin())
                        hit, cost = int(at[k]), int(costs[k])
            else:
                part = abs(cents)
                ok = free[key] & p.has & (p.size != 0) & (p.size < part)
                at = np.flatnonzero(ok if allowed is None else ok & allowed)
                if len(at):
                    at = at[(part % p.size[at]) == 0]
                hit = int(at[0]) if len(at) else None
            if hit is not None:
                taken.add(p.ids[hit])
                for other, k in places[p.ids[hit]]:
                    free[other][k] = False
                found.append((number, key, hit, s.name, cost))
                break
    return found
