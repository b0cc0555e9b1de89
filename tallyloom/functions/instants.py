"""Date and time texts in one normal form.

The grammar has too many branches for one generated method of the JVM, so distinct texts are read in Arrow batches;
callers pass each distinct text once, or only the texts of rows that need it.
"""

from __future__ import annotations

import re
from datetime import UTC, date, datetime, timedelta
from functools import lru_cache
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.amounts import WHITE_SPACE

#: A table of zone labels is read into the plan up to this many rows.
MOST_LABELS = 5000
#: Offsets from UTC reach this many minutes at most.
WIDEST_OFFSET = 14 * 60
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
MONTH_OF = {name[:n]: i for i, name in enumerate(MONTHS, 1) for n in (3, len(name))} | {"sept": 9}
DAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")
_CLOCK = r"(?P<hour>\d{1,2}):(?P<minute>\d{2})(?::(?P<second>\d{2})(?:[.,](?P<fraction>\d{1,9}))?)?(?: ?(?P<half>am|pm))?"
_ZONE = r"(?: ?(?P<zone>Z|[+-]\d{2}(?::?\d{2})?|[A-Z]{2,5}))?(?:\[(?P<region>[\w+/-]+)\])?"
_TIME = rf"(?:[T ]{_CLOCK}{_ZONE})?$"
FORMS = [
    re.compile(p + _TIME, re.I | re.A)
    for p in (
        r"(?P<y>\d{4})(?P<s>[-/.])(?P<m>\d{1,2})(?P=s)(?P<d>\d{1,2})",
        r"(?P<a>\d{1,2})(?P<s>[-/.])(?P<b>\d{1,2})(?P=s)(?P<y>\d{4}|\d{2})",
        r"(?:(?P<week>[a-z]{3}), )?(?P<d>\d{1,2})[ -](?P<name>[a-z]{3,9})[ -](?P<y>\d{4})",
        r"(?P<name>[a-z]{3,9}) (?P<d>\d{1,2}),? (?P<y>\d{4})",
        r"(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})",
    )
] + [re.compile(rf"(?P<y>\d{{4}})(?P<m>\d{{2}})(?P<d>\d{{2}})T?(?P<hour>\d{{2}})(?P<minute>\d{{2}})(?P<second>\d{{2}})(?:[.,](?P<fraction>\d{{1,9}}))?{_ZONE}$", re.I | re.A)]
EPOCH = re.compile(r"\d{10}(?:\d{3})?", re.A)


@lru_cache(512)
def _zone(name: str | None) -> ZoneInfo | None:
    try:
        return ZoneInfo(name) if name else None
    except Exception:  # noqa: BLE001  unknown or malformed name
        return None


def _instants(local: datetime, zone: ZoneInfo) -> list[datetime]:
    """The UTC instants at which the zone's clocks show local: none in a gap, two where they go back."""
    found = []
    for fold in (0, 1):
        at = local.replace(tzinfo=zone, fold=fold).astimezone(UTC)
        if at.astimezone(zone).replace(tzinfo=None) == local and at not in found:
            found.append(at)
    return found


def _offset(zone: str, labels: dict[str, int]) -> int | None:
    """Minutes that a written zone adds to UTC."""
    if zone[0] in "+-":
        digits = zone[1:].replace(":", "").ljust(4, "0")
        minutes = int(digits[:2]) * 60 + int(digits[2:])
        if int(digits[2:]) > 59 or minutes > WIDEST_OFFSET:
            return None
        return -minutes if zone[0] == "-" else minutes
    return 0 if zone.upper() == "Z" else labels.get(zone.upper())


def read_instant(text: str | None, date_order: str | None, tz_name: str | None, labels: dict[str, int]) -> date | datetime | None:
    """The single date, or instant in UTC, that a text names; None if it names none or more than one."""
    return read_moment(text, date_order, tz_name, labels)[0]


def read_moment(text: str | None, date_order: str | None, tz_name: str | None, labels: dict[str, int]) -> tuple[date | datetime | None, bool]:
    """(what read_instant gives, whether the text names a real day, with a real time if one is given, in some zone)."""
    nothing = None, False
    if text is None:
        return nothing
    text = text.strip(WHITE_SPACE)
    try:
        if EPOCH.fullmatch(text):
            n = int(text)
            return datetime.fromtimestamp(0, UTC) + (timedelta(seconds=n) if len(text) == 10 else timedelta(milliseconds=n)), True
        m = next((m for f in FORMS if (m := f.match(text))), None)
        if not m:
            return nothing
        g = m.groupdict()
        if "a" in g:
            if date_order not in ("DMY", "MDY"):
                return nothing
            d, mo = (g["a"], g["b"]) if date_order == "DMY" else (g["b"], g["a"])
            day = date(int(g["y"]) + 2000 * (len(g["y"]) == 2), int(mo), int(d))
        else:
            mo = MONTH_OF.get(g["name"].lower(), 0) if "name" in g else int(g["m"])
            day = date(int(g["y"]), mo, int(g["d"]))
        if g.get("week") and DAYS[day.weekday()] != g["week"].lower():
            return nothing
        if not g.get("hour"):
            return day, True
        hour, minute, second = int(g["hour"]), int(g["minute"]), int(g["second"] or 0)
        if half := g.get("half"):
            if not 1 <= hour <= 12:
                return nothing
            hour = hour % 12 + 12 * (half.lower() == "pm")
        local = datetime(day.year, day.month, day.day, hour, minute, second, int((g["fraction"] or "0").ljust(6, "0")[:6]))
        region = None
        if g["region"]:
            region = _zone(g["region"])
            if region is None:
                return nothing
        if g["zone"]:
            minutes = _offset(g["zone"], labels)
            if minutes is None:
                return nothing
            at = (local - timedelta(minutes=minutes)).replace(tzinfo=UTC)
            return (at, True) if region is None or at in _instants(local, region) else nothing
        region = region or _zone(tz_name)
        found = _instants(local, region) if region else []
        # A zone written in the text may skip or repeat the time, which then is none; a feed's zone leaves it a real time.
        return found[0] if len(found) == 1 else None, len(found) == 1 or not g["region"]
    except (ValueError, OverflowError):
        return nothing


def written(value: date | datetime | None) -> str | None:
    """`yyyy-MM-dd` for a date, `yyyy-MM-ddTHH:mm:ss.SSSSSSZ` for an instant."""
    if isinstance(value, datetime):
        return f"{value.year:04d}-{value:%m-%dT%H:%M:%S.%f}Z"
    return value.isoformat() if value else None


def label_map(zone_label: DataFrame) -> dict[str, int]:
    """A table (label, offset_min) as a dict; a table that is no small list of labels is refused. Empty or null labels are skipped."""
    rows = zone_label.select("label", "offset_min").limit(MOST_LABELS + 1).collect()
    if len(rows) > MOST_LABELS:
        raise ValueError(f"zone labels: more than {MOST_LABELS} rows")
    return {r["label"].upper(): r["offset_min"] for r in rows if r["label"] and r["offset_min"] is not None}


def moment_form(text: Column, date_order: Column, tz_name: Column, labels: dict[str, int]) -> Column:
    """norm, the normal form, and real, whether the text names a real day and time in some zone, as a struct."""

    @F.pandas_udf("struct<norm:string,real:boolean>")
    def read(texts: pd.Series, orders: pd.Series, zones: pd.Series) -> pd.DataFrame:
        found = [read_moment(*x, labels) for x in zip(texts, orders, zones, strict=True)]
        return pd.DataFrame({"norm": pd.Series([written(v) for v, _ in found], dtype=object), "real": pd.Series([r for _, r in found], dtype=bool)})

    return read(text, date_order, tz_name)


def normal_form(text: Column, date_order: Column, tz_name: Column, labels: dict[str, int]) -> Column:
    """`yyyy-MM-dd` for a date, `yyyy-MM-ddTHH:mm:ss.SSSSSSZ` in UTC for a time, else null.

    Null are: null, texts of no known form, dates or times that don't exist, a weekday
    that isn't the date's, offsets beyond 14 hours, unknown labels or zones, an offset that contradicts the zone
    named beside it, and local times that their zone skips or repeats. date_order ('DMY' or 'MDY') orders numeric dates
    that don't start with the year, tz_name is the zone of times without one. Decimals beyond the sixth are cut. White
    space at either end doesn't count.
    """
    return moment_form(text, date_order, tz_name, labels)["norm"]
