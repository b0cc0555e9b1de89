"""The registered queries of the core and, where SQL can say the same, that SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom import ledger_queries
from tallyloom.operators.copies import by_column, case_rows, diff_copies, ledger_differences, ledger_field_differences, reason_form
from tallyloom.operators.rejects import load_lines, loaded_rows, row_errors
from tallyloom.operators.timestamps import changed_timestamps, kept_dictionary
from tallyloom.tables import Tables
from tallyloom.value_sql import FEED, amount_cents, instants_sql, trimmed

Query = Callable[[SparkSession, str], DataFrame]


def over(f: Callable[[Tables], DataFrame]) -> Query:
    return lambda spark, folder: f(Tables(spark, folder))


def _in_cents(loaded: DataFrame) -> DataFrame:
    return loaded.withColumn("cents", (F.col("amount_value") * 100).cast("decimal(38,0)").cast("string")).drop("amount_value")


DATA_QUERIES: dict[str, Query] = {
    "p1_found": over(lambda t: ledger_differences(t.raw_txn, t.raw_txn_copy, t.unmatched, t.unmatched_copy, t.feed_info, t.zone_label)),
    "p1_differences": over(lambda t: ledger_field_differences(t.raw_txn, t.raw_txn_copy, t.unmatched, t.unmatched_copy, t.feed_info, t.zone_label)),
    "p1_reasons": over(lambda t: case_rows(diff_copies(t.unmatched, t.unmatched_copy, ["source_file", "source_row_number"], {"reason": by_column(reason_form)}), "unmatched", "source_row_number")),
    "p2_found": over(lambda t: changed_timestamps(t.raw_txn, "raw_id", ["value_date", "booking_date"], t.feed_info, t.zone_label, kept_dictionary(t.spark, t.folder))),
    "p5_found": over(lambda t: row_errors(load_lines(t.raw_line, t.feed_info, t.zone_label)).select("line_id", "reason")),
    "p5_loaded": over(lambda t: _in_cents(loaded_rows(load_lines(t.raw_line, t.feed_info, t.zone_label)))),
}

_REFERENCE = f"upper(translate({trimmed('reference')}, ' -/', ''))"
_P1 = rf"""
    a as (select distinct source_file, row_number, reference, amount, value_date from raw_txn), b as (select distinct source_file, row_number, reference, amount, value_date from raw_txn_copy),
    sides as (select *, {FEED.format('source_file')} as feed from (select 'l' as s, * from a union all select 'r', * from b)),
    {instants_sql("select feed, value_date as raw from sides")},
    n as (select sides.*, {_REFERENCE} as n_reference, coalesce('=' || cast({amount_cents('amount')} as varchar), '~' || amount) as n_amount, coalesce('=' || norm, '~' || value_date) as n_date
          from sides left join instants on sides.feed = instants.feed and sides.value_date = instants.raw),
    j as (select coalesce(x.source_file, y.source_file) as source_file, coalesce(x.row_number, y.row_number) as row_number, x.s as l, y.s as r,
                 x.reference as l_reference, y.reference as r_reference, x.amount as l_amount, y.amount as r_amount, x.value_date as l_date, y.value_date as r_date,
                 x.n_reference is distinct from y.n_reference as d_reference, x.n_amount is distinct from y.n_amount as d_amount, x.n_date is distinct from y.n_date as d_date
          from (select * from n where s = 'l') x full join (select * from n where s = 'r') y on x.source_file = y.source_file and x.row_number = y.row_number),
    ua as (select distinct source_file, source_row_number, reason from unmatched), ub as (select distinct source_file, source_row_number, reason from unmatched_copy),
    uj as (select coalesce(ua.source_file, ub.source_file) as source_file, coalesce(ua.source_row_number, ub.source_row_number) as row_number, ua.source_file is not null as l, ub.source_file is not null as r, ua.reason as l_reason, ub.reason as r_reason,
                  lower(regexp_replace(ua.reason, '[\s_]+', '', 'g')) is distinct from lower(regexp_replace(ub.reason, '[\s_]+', '', 'g')) as d_reason
           from ua full join ub on ua.source_file = ub.source_file and ua.source_row_number = ub.source_row_number),
    found as (select 'raw_txn' as tab, source_file, row_number, 'left' as side, null as field, null as left_value, null as right_value from j where r is null
              union all select 'raw_txn', source_file, row_number, 'right', null, null, null from j where l is null
              union all select 'raw_txn', source_file, row_number, 'both', 'reference', l_reference, r_reference from j where l is not null and r is not null and d_reference
              union all select 'raw_txn', source_file, row_number, 'both', 'amount', l_amount, r_amount from j where l is not null and r is not null and d_amount
              union all select 'raw_txn', source_file, row_number, 'both', 'value_date', l_date, r_date from j where l is not null and r is not null and d_date
              union all select 'unmatched', source_file, row_number, 'left', null, null, null from uj where not r
              union all select 'unmatched', source_file, row_number, 'right', null, null, null from uj where not l
              union all select 'unmatched', source_file, row_number, 'both', 'reason', l_reason, r_reason from uj where l and r and d_reason)
"""
_FIELD = "(\"(?:[^\"]|\"\")*\"|[^\"\\r\\n' || d || ']*)"
_P5 = rf"""
    l as (select raw_line.*, {FEED.format('source_file')} as feed, delimiter as d from raw_line left join feed_info on feed_info.feed = {FEED.format('source_file')}),
    shaped as (select *, case when d is not null then '^' || '{_FIELD}' || repeat('[' || d || ']' || '{_FIELD}', 7) || '$' end as shape from l),
    sound as (select *, coalesce(regexp_matches(line, shape), false) as ok from shaped),
    cut as (select *, {', '.join(f"case when ok then regexp_extract(line, shape, {i}) end as q{i}" for i in range(1, 9))} from sound),
    f as (select *, {', '.join(f"case when q{i}[1] = chr(34) then replace(q{i}[2:-2], chr(34) || chr(34), chr(34)) else q{i} end as f{i}" for i in range(1, 9))} from cut),
    {instants_sql("select feed, f4 as raw from f")},
    v as (select f.*, {amount_cents('f2')} as cents, norm, coalesce(real, false) as real from f left join instants on f.feed = instants.feed and f.f4 = instants.raw),
    judged as (select *, case when not ok then 'MalformedRow' when cents is null then 'InvalidAmount' when not real then 'InvalidDate' end as why from v)
"""
DATA_SQL: dict[str, str] = {
    "p1_found": f"with {_P1} select distinct tab, source_file, row_number, coalesce(field, case side when 'left' then 'missing_in_copy' else 'missing_in_main' end) as diff from found",
    "p1_differences": f"with {_P1} select distinct tab, source_file, row_number, side, field, left_value, right_value from found",
    "p1_reasons": f"with {_P1} select distinct tab, source_file, row_number, coalesce(field, case side when 'left' then 'missing_in_copy' else 'missing_in_main' end) as diff from found where tab = 'unmatched'",
    "p2_found": f"""
        with v as (select raw_id, 'value_date' as field, value_date as raw, {FEED.format('source_file')} as feed from raw_txn union all select raw_id, 'booking_date', booking_date, {FEED.format('source_file')} from raw_txn),
        {instants_sql("select feed, raw from v")}
        select raw_id, field, norm from v join instants using (feed, raw) where norm <> raw""",
    "p5_found": f"with {_P5} select line_id, why as reason from judged where why is not null",
    "p5_loaded": f"with {_P5} select line_id, source_file, row_number, f1 as reference, f2 as amount, f3 as currency, f4 as value_date, f5 as description, f6 as iban, f7 as counterparty_name, f8 as booking_date, cast(cents as varchar) as cents, norm as value_at from judged where why is null",
}


def queries() -> dict[str, Query]:
    return DATA_QUERIES | ledger_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return DATA_SQL | ledger_queries.SQL
