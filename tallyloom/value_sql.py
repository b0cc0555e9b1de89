"""The SQL that reads amounts and instants as the engine does, for the registered queries to be held against."""

from __future__ import annotations

WHITE = r"[\s\x{85}\p{Z}]+"


def trimmed(text: str) -> str:
    return rf"regexp_replace({text}, '^{WHITE}|{WHITE}$', '', 'g')"


#: Fixed value: an amount with two decimals at most, the other mark grouping digits.
BODY = r"(\d+|\d+[.,]\d{2}|\d{1,3}(,\d{3})+\.\d{2}|\d{1,3}(\.\d{3})+,\d{2})"


def amount_cents(text: str) -> str:
    """Cents of a text, null if it is no amount (strict reading)."""
    t = trimmed(text)
    whole = rf"\(\s*{BODY}\s*\)|-\s*{BODY}|{BODY}\s*-|{BODY}"
    return rf"case when regexp_full_match({t}, '{whole}') then (case when regexp_matches({t}, '[-(]') then -1 else 1 end) * try_cast(regexp_replace({t}, '[^0-9]', '', 'g') as hugeint) * (case when regexp_matches({t}, '[.,]') then 1 else 100 end) end"


_MONTHS = "list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], lower(substr(nm, 1, 3)))"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?(?: ?([aApP][mM]))?"
_ZONE = r"(?: ?([Zz]|[+-]\d{2}(?::?\d{2})?|[A-Za-z]{2,5}))?(?:\[([\w+/-]+)\])?"
_TAIL = rf"((?:[T ]{_CLOCK}{_ZONE})?)"
#: Dates without their times: kind of form, pattern, and the texts of year, month, day and month name.
_FORMS = [
    *((f"i{i}", rf"(\d{{4}})[{s}](\d{{1,2}})[{s}](\d{{1,2}}){_TAIL}", "g1", "g2", "g3", "''") for i, s in enumerate("-/.")),
    *((f"n{i}", rf"(\d{{1,2}})[{s}](\d{{1,2}})[{s}](\d{{4}}|\d{{2}}){_TAIL}", "case when length(g3) = 2 then '20' || g3 else g3 end", "case date_order when 'DMY' then g2 when 'MDY' then g1 end", "case date_order when 'DMY' then g1 when 'MDY' then g2 end", "''") for i, s in enumerate("-/.")),
    ("w", rf"(?:[A-Za-z]{{3}}, )?(\d{{1,2}})[ -]([A-Za-z]{{3,9}})[ -](\d{{4}}){_TAIL}", "g3", "''", "g1", "g2"),
    ("m", rf"([A-Za-z]{{3,9}}) (\d{{1,2}}),? (\d{{4}}){_TAIL}", "g3", "''", "g2", "g1"),
    ("c", rf"(\d{{4}})(\d{{2}})(\d{{2}}){_TAIL}", "g1", "g2", "g3", "''"),
    ("t", rf"(\d{{4}})(\d{{2}})(\d{{2}})(T?\d{{6}}(?:[.,]\d{{1,9}})?{_ZONE})", "g1", "g2", "g3", "''"),
]


def instants_sql(texts: str, name: str = "instants") -> str:
    """CTEs that end in `name`: feed, raw, norm, real for each distinct (feed, raw) of the query texts."""
    which = "case " + " ".join(f"when regexp_full_match(t, '{p}') then '{k}'" for k, p, *_ in _FORMS) + " end"
    pick = lambda i: "case kind " + " ".join(f"when '{k}' then regexp_extract(t, '^{p}$', {i})" for k, p, *_ in _FORMS) + " end"
    part = lambda j: "case kind " + " ".join(f"when '{f[0]}' then {f[j]}" for f in _FORMS) + " end"
    clock = rf"^[T ]{_CLOCK}{_ZONE}$"
    tight = rf"^T?(\d{{2}})(\d{{2}})(\d{{2}})(?:[.,](\d{{1,9}}))?{_ZONE}$"
    one = lambda i, j: f"case when kind = 't' then regexp_extract(tail, '{tight}', {j}) when tail <> '' then regexp_extract(tail, '{clock}', {i}) end"
    shift = lambda zone, sign: f"(epoch_us(timezone({zone}, timezone('UTC', loc {sign} interval 1 day))) - epoch_us(loc {sign} interval 1 day))"
    holds = lambda zone, u: f"timezone({zone}, timezone('UTC', make_timestamp({u}))) = loc"
    return rf"""
        {name}_t as (select distinct feed, raw, {trimmed('raw')} as t, date_order, tz_name from ({texts}) x left join feed_info f using (feed) where raw is not null),
        {name}_k as (select *, case when regexp_full_match(t, '\d{{10}}|\d{{13}}') then 'epoch' else {which} end as kind from {name}_t),
        {name}_g as (select *, {pick(1)} as g1, {pick(2)} as g2, {pick(3)} as g3, coalesce({pick(4)}, '') as tail, case when kind = 'w' then regexp_extract(t, '^([A-Za-z]{{3}}), ', 1) else '' end as wk from {name}_k),
        {name}_p as (select *, {part(2)} as yy, {part(3)} as mm, {part(4)} as dd, {part(5)} as nm, {one(1, 1)} as hh, {one(2, 2)} as mi, {one(3, 3)} as ss, {one(4, 4)} as fr, case when kind = 't' then '' else {one(5, 4)} end as half, {one(6, 5)} as zn, {one(7, 6)} as rg from {name}_g),
        {name}_d as (select *, try_cast(yy || '-' || lpad(case when nm <> '' then cast({_MONTHS} as varchar) else mm end, 2, '0') || '-' || lpad(dd, 2, '0') as date) as day,
                            case when half <> '' then (case when try_cast(hh as int) between 1 and 12 then try_cast(hh as int) % 12 + (case when lower(half) = 'pm' then 12 else 0 end) end) else try_cast(hh as int) end as h from {name}_p),
        {name}_l as (select *, case when rg in (select name from pg_timezone_names()) then rg end as rz, day is not null and (wk = '' or lower(wk) = lower(strftime(day, '%a'))) as day_ok,
                            case when h < 24 and try_cast(mi as int) < 60 and coalesce(try_cast(nullif(ss, '') as int), 0) < 60 then
                            cast(day as timestamp) + to_microseconds(cast((h * 3600 + cast(mi as int) * 60 + coalesce(try_cast(nullif(ss, '') as int), 0)) as bigint) * 1000000 + coalesce(try_cast(substr(rpad(nullif(fr, ''), 6, '0'), 1, 6) as int), 0)) end as loc from {name}_d),
        {name}_o as (select *, case when zn is null or zn = '' then null when regexp_matches(zn, '^[+-]') then
                            (case when coalesce(try_cast(nullif(substr(replace(zn, ':', ''), 4, 2), '') as int), 0) < 60 and cast(substr(zn, 2, 2) as int) * 60 + coalesce(try_cast(nullif(substr(replace(zn, ':', ''), 4, 2), '') as int), 0) <= 840 then
                             (case when zn[1] = '-' then -1 else 1 end) * (cast(substr(zn, 2, 2) as int) * 60 + coalesce(try_cast(nullif(substr(replace(zn, ':', ''), 4, 2), '') as int), 0)) end)
                            when upper(zn) = 'Z' then 0 else (select max(offset_min) from zone_label where upper(label) = upper(zn)) end as off, case when rg <> '' then rz else tz_name end as zone from {name}_l),
        {name}_u as (select *, case when kind <> 'epoch' and day_ok and loc is not null and (zn is null or zn = '') and zone is not null then list_distinct(list_filter([epoch_us(loc) - {shift('zone', '-')}, epoch_us(loc) - {shift('zone', '+')}], lambda u: {holds('zone', 'u')})) end as us,
                            epoch_us(loc) - cast(off as bigint) * 60000000 as utc_us from {name}_o),
        {name} as (select feed, raw,
                          case when kind = 'epoch' then strftime(make_timestamp(cast(t as bigint) * (case length(t) when 10 then 1000000 else 1000 end)), '%Y-%m-%dT%H:%M:%S.%fZ') when not day_ok then null when tail = '' then strftime(day, '%Y-%m-%d') when loc is null then null
                               when zn <> '' then (case when off is not null and (rg = '' or coalesce(timezone(rz, timezone('UTC', make_timestamp(utc_us))) = loc, false)) then strftime(make_timestamp(utc_us), '%Y-%m-%dT%H:%M:%S.%fZ') end)
                               when len(us) = 1 then strftime(make_timestamp(us[1]), '%Y-%m-%dT%H:%M:%S.%fZ') end as norm,
                          case when kind = 'epoch' then true when kind is null or not day_ok then false when tail = '' then true when loc is null then false
                               when zn <> '' then coalesce(off is not null and (rg = '' or coalesce(timezone(rz, timezone('UTC', make_timestamp(utc_us))) = loc, false)), false) when rg <> '' then coalesce(len(us) = 1, false) else true end as real from {name}_u)
    """


_HOURS = r"(?:[T ](\d{1,2}):(\d{2})(?::(\d{2})(?:\.(\d{1,9}))?)?(?: ?(Z|UTC|GMT|[+-]\d{2}(?::?\d{2})?))?)?"
#: The lenient reading of the normaliser: kind, pattern of the date, texts of year, month and day.
_LOOSE = [
    ("y", r"(\d{4})[-/](\d{1,2})[-/](\d{1,2})", "g1", "g2", "g3"),
    *((f"l{i}", rf"(\d{{1,2}})[{s}](\d{{1,2}})[{s}](\d{{4}})", "g3", "case when cast(g1 as int) <= 12 then g1 else g2 end", "case when cast(g1 as int) <= 12 then g2 else g1 end") for i, s in enumerate("-/.")),
]


def dates_sql(texts: str, name: str = "dates") -> str:
    """CTEs that end in `name`: raw and at_utc for each distinct raw of the query texts, as the normaliser reads them."""
    which = "case " + " ".join(f"when regexp_full_match(t, '{p}{_HOURS}') then '{k}'" for k, p, *_ in _LOOSE) + r" when regexp_full_match(t, '\d{8}') then 'c' end"
    pick = lambda i: "case kind " + " ".join(f"when '{k}' then regexp_extract(t, '^{p}{_HOURS}$', {i})" for k, p, *_ in _LOOSE) + " end"
    part = lambda j: "case kind " + " ".join(f"when '{f[0]}' then {f[j]}" for f in _LOOSE) + f" when 'c' then substr(t, {(1, 5, 7)[j - 2]}, {(4, 2, 2)[j - 2]}) end"
    worded = ["%d %b %Y", "%b %d, %Y", "%m/%d/%Y %I:%M:%S %p", "%d %b %Y %H:%M:%S"]
    number = lambda c: f"coalesce(try_cast(nullif({c}, '') as int), 0)"
    fraction = number("substr(rpad(nullif(g7, ''), 6, '0'), 1, 6)")
    return rf"""
        {name}_t as (select distinct raw, {trimmed('raw')} as t from ({texts}) x where raw is not null),
        {name}_k as (select *, {which} as kind from {name}_t),
        {name}_g as (select *, {', '.join(f'{pick(i)} as g{i}' for i in range(1, 9))} from {name}_k),
        {name}_p as (select *, try_cast({part(2)} || '-' || lpad({part(3)}, 2, '0') || '-' || lpad({part(4)}, 2, '0') as date) as day, replace(coalesce(g8, ''), ':', '') as z, regexp_replace(t, '^[A-Za-z]{{3}}, ', '') as plain from {name}_g),
        {name}_q as (select *, case when regexp_full_match(plain, '.* [+-]\d{{4}}') then left(plain, length(plain) - 6) else plain end as base,
                            case when regexp_full_match(plain, '.* [+-]\d{{4}}') then (case substr(plain, length(plain) - 4, 1) when '-' then -1 else 1 end) * (cast(substr(plain, length(plain) - 3, 2) as int) * 60 + cast(right(plain, 2) as int)) else 0 end as w_off from {name}_p),
        {name} as (select raw, case when day is not null and {number('g4')} < 24 and {number('g5')} < 60 and {number('g6')} < 60 then
                                 cast(day as timestamp) + to_microseconds(cast({number('g4')} * 3600 + {number('g5')} * 60 + {number('g6')} as bigint) * 1000000 + {fraction})
                                 - to_minutes(case when left(z, 1) in ('+', '-') then (case left(z, 1) when '-' then -1 else 1 end) * (cast(substr(z, 2, 2) as int) * 60 + {number('substr(z, 4, 2)')}) else 0 end)
                               when kind is null then try_strptime(base, [{', '.join(f"'{f}'" for f in worded)}]) - to_minutes(w_off) end as at_utc from {name}_q)
    """


FEED = "split_part({0}, '_', 1)"
