"""The registered queries of the reconciliation operators, each with the SQL that gives the same.

Amounts come out in cents, scores in ten-thousandths and dates as text, so no engine's way of writing them matters.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.enums import Discrepancy
from tallyloom.functions import predicates as P
from tallyloom.functions import results as R
from tallyloom.functions import scalar as S
from tallyloom.ledgers import SOURCE_SQL, TARGET_SQL, ledgers
from tallyloom.operators.classify import classify, reason_counts, reference_groups
from tallyloom.operators.match import bucket_sizes, match, match_exact, match_results, unmatched_sources, unmatched_targets
from tallyloom.operators.normalize import normalize
from tallyloom.operators.reconcile import reconcile, summary
from tallyloom.options import ReconOptions, ToleranceRule
from tallyloom.plans.shared import own_folder, spread, write_table
from tallyloom.plans.strategies import Fuzzy, Partial, pipeline_from_names
from tallyloom.schemas import RAW
from tallyloom.sources.files import page, read_raw
from tallyloom.tables import Tables
from tallyloom.value_sql import dates_sql, trimmed

Query = Callable[[SparkSession, str], DataFrame]
OPTIONS = ReconOptions()


def over(f: Callable[[Tables], DataFrame]) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return f(Tables(spark, folder))

    return run


def cents(amount: Column) -> Column:
    return (amount.cast("decimal(20,2)") * 100).cast("bigint")


def points(score: Column) -> Column:
    return (score.cast("decimal(10,4)") * 10000).cast("bigint")


def _distinct(column: str, f: Callable[[Column], Column], out: str) -> Query:
    return over(lambda t: t.raw_txn.select(column).distinct().select(F.col(column).alias("raw"), f(F.col(column)).alias(out)))


def _both(t: Tables) -> tuple[DataFrame, DataFrame]:
    return ledgers(t.orders)


def _matched(t: Tables, pipeline=None) -> DataFrame:
    s, g = _both(t)
    return match(s, g, OPTIONS, pipeline)


def _shown(pairs: DataFrame, *more: str) -> DataFrame:
    return pairs.select(*more, "ref", "currency", "s_ordinal", "t_ordinal", cents(F.col("s_amount")).alias("s_cents"), cents(F.col("t_amount")).alias("t_cents"), F.col("s_date").cast("string").alias("s_date"), F.col("t_date").cast("string").alias("t_date"), "strategy", points(F.col("score")).alias("score_bp"))


def _candidates(t: Tables, strategy) -> DataFrame:
    s, g = _both(t)
    x = s.select("ref", "currency", F.struct("ordinal", "amount", F.col("value_date").alias("date")).alias("x"))
    y = g.select("ref", "currency", F.struct("ordinal", "amount", F.col("value_date").alias("date")).alias("y"))
    met = x.join(y, ["ref", "currency"]).where(strategy.eligible(F.col("x"), F.col("y"), OPTIONS))
    return met.select("ref", "currency", F.col("x.ordinal").alias("s_ordinal"), F.col("y.ordinal").alias("t_ordinal"), points(F.round(strategy.score(F.col("x"), F.col("y"), OPTIONS), 4)).alias("score_bp"))


def _left(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    s, g = _both(t)
    pairs = write_table(match(s, g, OPTIONS), "pairs")
    return unmatched_sources(s, pairs).drop("reason"), unmatched_targets(g, pairs), pairs


def _classified(t: Tables) -> DataFrame:
    return classify(*_left(t))


def _of_reason(reason: Discrepancy) -> Query:
    return over(lambda t: _classified(t).where(F.col("reason") == reason.value).select("ordinal", "ref"))


def _neighbours(t: Tables) -> DataFrame:
    """Lines of an order next to each other: pairs of amounts and days for the predicates."""
    a = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.max(F.col("l_extendedprice").cast("decimal(18,2)")).alias("amount"), F.max(F.to_date("l_shipdate")).alias("day"))
    b = a.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("amount").alias("other"), F.col("day").alias("other_day"))
    return a.join(b, ["l_orderkey", "l_linenumber"])


_LINES = """
    a as (select l_orderkey, l_linenumber, max(cast(l_extendedprice as decimal(18,2))) as amount, max(cast(l_shipdate as date)) as day from lineitem group by all),
    n as (select a.l_orderkey, a.l_linenumber, a.amount, a.day, b.amount as other, b.day as other_day,
                 cast(a.amount * 100 as bigint) as c, cast(b.amount * 100 as bigint) as oc
          from a join a b on a.l_orderkey = b.l_orderkey and a.l_linenumber = b.l_linenumber - 1)
"""
WIDE = ToleranceRule(1000, 10, 30)
REORDERED = ["Partial", "Exact"]

QUERIES: dict[str, Query] = {
    "norm_reference": _distinct("reference", S.normalize_reference, "ref"),
    "norm_amount": _distinct("amount", lambda c: cents(S.normalize_amount(c)), "cents"),
    "norm_date": over(lambda t: t.raw_txn.select("value_date").distinct().select(F.col("value_date").alias("raw"), F.date_format(S.parse_date(F.col("value_date")), "yyyy-MM-dd HH:mm:ss").alias("at"))),
    "norm_description": _distinct("description", S.normalize_description, "description"),
    "norm_iban": _distinct("iban", S.normalize_iban, "iban"),
    "norm_currency": _distinct("currency", S.currency_code, "currency"),
    "norm_counterparty": _distinct("counterparty_name", S.wide_trim, "name"),
    "norm_full": over(lambda t: normalize(t.raw_txn)[0].select("source_file", "source_row_number", "ref", "currency", cents(F.col("amount")).alias("cents"), F.col("value_date").cast("string").alias("value_date"), "description", "iban", "counterparty_name")),
    "norm_rejects": over(lambda t: normalize(t.raw_txn)[1].select("source_file", "row_number", "error_code", "error_field", "error_message")),
    "money_rounding": over(lambda t: t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", cents(S.round_money(F.col("l_extendedprice").cast("decimal(18,2)") * F.col("l_discount").cast("decimal(4,2)"))).alias("cents"))),
    "money_minor_units": over(lambda t: t.orders.select("o_orderkey", S.minor_units(F.col("o_totalprice").cast("decimal(18,2)")).alias("units"), cents(S.from_minor_units(S.minor_units(F.col("o_totalprice").cast("decimal(18,2)")))).alias("cents"))),
    "money_sums": over(lambda t: _neighbours(t).select("l_orderkey", "l_linenumber", cents(S.add_money(F.col("amount"), F.lit("EUR"), F.col("other"), F.lit("EUR"))).alias("added"), cents(S.subtract_money(F.col("amount"), F.lit("EUR"), F.col("other"), F.lit("EUR"))).alias("taken"))),
    "tolerance_amount": over(lambda t: _neighbours(t).select("l_orderkey", "l_linenumber", P.amount_within(F.col("amount"), F.col("other"), WIDE).alias("within"), P.money_within_absolute(F.col("amount"), F.col("other"), 1000).alias("absolute"), P.money_within_percentage(F.col("amount"), F.col("other"), 10).alias("percentage"))),
    "tolerance_date": over(lambda t: _neighbours(t).select("l_orderkey", "l_linenumber", P.date_within(F.col("day"), F.col("other_day"), WIDE).alias("within"))),
    "confidence_bands": over(lambda t: t.lineitem.select(S.confidence(F.col("l_discount").cast("decimal(10,4)") * 9).alias("score")).groupBy(points(F.col("score")).alias("score_bp"), S.confidence_band(F.col("score")).alias("band")).agg(F.count(F.lit(1)).alias("n"))),
    "divisibility_decimal": over(lambda t: _neighbours(t).select("l_orderkey", "l_linenumber", P.partial_split(F.col("amount"), F.lit("12.50").cast("decimal(18,2)")).alias("splits"), F.coalesce(P.divides_decimal(F.col("amount"), F.lit("0.05").cast("decimal(18,2)")), F.lit(False)).alias("divides"))),
    "divisibility_scaled": over(lambda t: _neighbours(t).select("l_orderkey", "l_linenumber", P.partial_split(F.col("amount"), F.lit("12.50").cast("decimal(18,2)"), P.divides_scaled).alias("splits"), F.coalesce(P.divides_scaled(F.col("amount"), F.lit("0.05").cast("decimal(18,2)")), F.lit(False)).alias("divides"))),
    "transaction_ids": over(lambda t: t.raw_txn.select("raw_id", S.transaction_id(F.lit("S"), F.col("source_file"), F.col("row_number")).alias("txn_id")).withColumn("valid", S.valid_transaction_id(F.col("txn_id")))),
    "index_buckets": over(lambda t: bucket_sizes(*_both(t))),
    "fuzzy_candidates": over(lambda t: _candidates(t, Fuzzy())),
    "partial_candidates": over(lambda t: _candidates(t, Partial())),
    "match_exact": over(lambda t: _shown(match_exact(*_both(t), OPTIONS))),
    "match_fuzzy": over(lambda t: _shown(_matched(t, [Fuzzy()]))),
    "match_partial": over(lambda t: _shown(_matched(t, [Partial()]))),
    "match_cascade": over(lambda t: _shown(_matched(t))),
    "match_reordered_pipeline": over(lambda t: _shown(_matched(t, pipeline_from_names(REORDERED, "ScaledLong")))),
    "match_results": over(lambda t: match_results(_both(t)[0], _matched(t)).select("ordinal", "ref", "currency", "t_ordinal", "strategy", points(F.col("score")).alias("score_bp"), "kind", "reason")),
    "unmatched_sources": over(lambda t: _left(t)[0].select("ordinal", "ref", "currency")),
    "unmatched_targets": over(lambda t: _left(t)[1].select("ordinal", "ref", "currency")),
    "leg_counts": over(lambda t: reference_groups(*_left(t)).select("ref", "sc", "tc", "ms", "mt", (F.col("sc") + F.col("ms")).alias("source_legs"), (F.col("tc") + F.col("mt")).alias("target_legs"))),
    "dup_in_source": _of_reason(Discrepancy.DUPLICATE_IN_SOURCE),
    "dup_in_target": _of_reason(Discrepancy.DUPLICATE_IN_TARGET),
    "split_payment": _of_reason(Discrepancy.SPLIT_PAYMENT),
    "consolidated_payment": _of_reason(Discrepancy.CONSOLIDATED_PAYMENT),
    "amount_mismatch": _of_reason(Discrepancy.AMOUNT_MISMATCH),
    "date_mismatch": _of_reason(Discrepancy.DATE_MISMATCH),
    "missing_in_target": _of_reason(Discrepancy.MISSING_IN_TARGET),
    "missing_in_source": _of_reason(Discrepancy.MISSING_IN_SOURCE),
    "classify_all": over(lambda t: _classified(t).select("ordinal", "ref", "currency", cents(F.col("amount")).alias("cents"), F.col("value_date").cast("string").alias("value_date"), "reason")),
    "classify_ledgers": over(lambda t: classify(*_both(t)).select("ordinal", "ref", "reason").groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.sum("ordinal").cast("bigint").alias("ordinals"))),
    "reason_counts": over(lambda t: reason_counts(_classified(t))),
    "match_rate_summary": over(lambda t: summary(*_both(t), _matched(t)).select("total_source", "total_target", "matched", "exact_count", "fuzzy_count", "partial_count", "unmatched_source", "unmatched_target", (F.col("match_rate") * 100).cast("bigint").alias("match_rate_bp"))),
    "reconcile_end_to_end": over(lambda t: _end_to_end(t)),
}


def _sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    return t.txn_source, t.txn_target


def _transaction_pairs(t: Tables) -> DataFrame:
    return match(*_sides(t), OPTIONS)


def _transactions_left(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    pairs = write_table(_transaction_pairs(t), "pairs")
    source, target = _sides(t)
    return unmatched_sources(source, pairs).drop("reason"), unmatched_targets(target, pairs), pairs


def _reconciled_raw(t: Tables) -> DataFrame:
    """Both systems' raw rows, every one of them with what became of it: matched, unmatched for a reason, or rejected."""
    report = reconcile(t.raw_txn, t.raw_txn_copy, OPTIONS)
    rows = report.unmatched.select("side", "source_file", F.col("source_row_number").alias("row_number"), F.col("reason").alias("outcome"))
    rows = rows.unionByName(report.rejects.select(F.col("error_side").alias("side"), "source_file", "row_number", F.lit("Rejected").alias("outcome")))
    for side, kept in (("S", report.sources), ("T", report.targets)):
        met = kept.join(report.pairs.select(F.col(f"{side.lower()}_id").alias("ordinal"), "strategy"), "ordinal")
        rows = rows.unionByName(met.select("side", "source_file", F.col("source_row_number").alias("row_number"), F.concat(F.lit("Matched"), F.col("strategy")).alias("outcome")))
    return rows.groupBy("side", "source_file", "row_number", "outcome").agg(F.count(F.lit(1)).alias("n"))


def _counters(t: Tables) -> DataFrame:
    """The report's counters over both systems' raw rows."""
    report = reconcile(t.raw_txn, t.raw_txn_copy, OPTIONS)
    cols = ("total_source", "total_target", "matched", "exact_count", "fuzzy_count", "partial_count", "unmatched_source", "unmatched_target", "skipped_rows", "total_errors", "dead_letter_files")
    return report.summary.select(*cols, (F.col("match_rate") * 100).cast("bigint").alias("match_rate_bp"))


def _written(t: Tables, label: str) -> str:
    return f"{own_folder(t.spark)}/{label}-{uuid.uuid4().hex}"


def _through_json(t: Tables) -> DataFrame:
    """Raw rows written as JSON, an object a line, and read back."""
    folder = _written(t, "raw-json")
    t.raw_txn.select(*RAW.fieldNames()).write.json(folder)
    return read_raw(t.spark, folder, "Json")[0].select(*RAW.fieldNames())


def _through_mt940(t: Tables) -> DataFrame:
    """Orders written as statements of a thousand keys, and read back."""
    folder, key = _written(t, "statements"), F.col("o_orderkey")
    orders = t.orders.select(key, F.floor(key / 1000).alias("stmt"), F.date_format("o_orderdate", "yyMMdd").alias("day"), F.replace(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(",")).alias("amount"), "o_orderpriority")
    lines = orders.select("stmt", key.alias("at"), F.concat(F.lit(":61:"), "day", F.when(key % 3 == 0, "D").otherwise("C"), "amount", F.lit("NTRFORD"), key.cast("string"), F.lit("\n:86:"), "o_orderpriority").alias("line"))
    head = orders.select("stmt").distinct().select("stmt", F.lit(-1).cast("bigint").alias("at"), F.concat(F.lit(":20:S"), F.col("stmt").cast("string"), F.lit("\n:25:BANK/DE00"), F.col("stmt").cast("string"), F.lit("\n:60F:C240101EUR0,00")).alias("line"))
    lines.unionByName(head).repartition("stmt").sortWithinPartitions("stmt", "at").select("stmt", "line").write.partitionBy("stmt").text(folder)
    return read_raw(t.spark, f"{folder}/*/*", "Mt940")[0].select("reference", "amount", "currency", "value_date", "description", "iban", "row_number")


def _money(t: Tables) -> DataFrame:
    rows = t.raw_txn.where(S.currency_code(F.col("currency")).isNotNull()).select(S.money(S.parse_amount(F.col("amount")), F.col("currency")).alias("m"))
    return rows.where("m.amount is not null").groupBy("m.currency").agg(F.count(F.lit(1)).alias("n"), F.sum(cents(F.col("m.amount"))).cast("bigint").alias("cents"))


def _chained(t: Tables) -> DataFrame:
    """Half of each amount in cents, or the first error on the way: no number, then below zero."""
    number = R.checked(S.normalize_amount(F.col("amount")), "decimal(18,2)", "no number")
    positive = R.then(number, lambda v: F.when(v >= 0, R.success(v)).otherwise(R.failure("below zero", "decimal(18,2)")), "decimal(18,2)")
    half = R.mapped(positive, lambda v: F.floor(v * 50), "bigint")
    return t.raw_txn.select("raw_id", half.alias("r")).select("raw_id", F.col("r.value").alias("half_cents"), F.col("r.error.message").alias("message"))


def _contended(t: Tables) -> DataFrame:
    """Lines of an order against its lines at a tenth less or more: many sources a bucket want the same few targets."""
    lines = t.lineitem.select(F.col("l_orderkey").cast("string").alias("ref"), F.lit("EUR").alias("currency"), F.col("l_quantity").cast("decimal(18,2)").alias("amount"), F.to_date("l_shipdate").alias("value_date"), (F.col("l_orderkey") * 1_000_000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("ordinal"))
    lines = lines.groupBy("ref", "currency", "ordinal").agg(F.max("amount").alias("amount"), F.max("value_date").alias("value_date"))
    pairs = match(lines, lines.withColumn("value_date", F.date_add("value_date", 20)), OPTIONS)
    return pairs.select("ref", "s_ordinal", "t_ordinal", "strategy", points(F.col("score")).alias("score_bp"))


QUERIES |= {
    "match_transactions": over(lambda t: _shown(_transaction_pairs(t), "s_id", "t_id")),
    "match_transactions_reordered": over(lambda t: _shown(match(*_sides(t), OPTIONS, pipeline_from_names(REORDERED, "ScaledLong")), "s_id", "t_id")),
    "transaction_legs": over(lambda t: reference_groups(*_transactions_left(t)).select("ref", "sc", "tc", "ms", "mt")),
    "classify_transactions": over(lambda t: classify(*_transactions_left(t)).select("txn_id", "side", "ref", "currency", "reason")),
    "reconcile_raw": over(_reconciled_raw),
    "report_counters": over(_counters),
    "report_page": over(lambda t: page(_transaction_pairs(t), ["s_ordinal"], 2, 100).select("s_id", "t_id", "strategy")),
    "files_json": over(_through_json),
    "files_mt940": over(_through_mt940),
    "money_of": over(lambda t: _money(t)),
    "result_chain": over(lambda t: _chained(t)),
    "drafted_options": over(lambda t: _shown(match(*_sides(t), ReconOptions.draft().fuzzy("0.70", "0.95").tolerance(absolute=5).build()), "s_id", "t_id")),
    "transaction_id_rejects": over(lambda t: t.raw_txn.select("raw_id", F.coalesce("reference", F.lit("")).alias("text")).where(~S.valid_transaction_id(F.col("text")))),
    "match_contended": over(lambda t: _contended(t)),
}


def _as_raw(rows: DataFrame, file: str) -> DataFrame:
    """A ledger written as text: references in lower case with hyphens, amounts with commas."""
    return rows.select(
        F.lower(F.concat_ws("-", F.substring("ref", 1, 3), F.expr("substring(ref, 4)"))).alias("reference"), F.replace(F.col("amount").cast("string"), F.lit("."), F.lit(",")).alias("amount"), F.concat(F.lit(" "), F.lower("currency")).alias("currency"),
        F.date_format("value_date", "yyyyMMdd").alias("value_date"), F.lit("payment").alias("description"), F.lit(None).cast("string").alias("iban"), F.lit(None).cast("string").alias("counterparty_name"), F.lit(None).cast("string").alias("booking_date"),
        F.col("ordinal").cast("int").alias("row_number"), F.lit(file).alias("source_file"),
    )


def _end_to_end(t: Tables) -> DataFrame:
    s, g = _both(t)
    folder = f"{own_folder(s.sparkSession)}/ledger-files-{uuid.uuid4().hex}"
    for side, rows in (("source", s), ("target", g)):
        _as_raw(spread(rows), f"{side}.csv").write.option("header", True).csv(f"{folder}/{side}")
    report = reconcile(*[read_raw(s.sparkSession, f"{folder}/{side}", "Csv")[0] for side in ("source", "target")], OPTIONS)
    number = F.col("source_row_number").cast("bigint").alias("ordinal")
    labels = report.unmatched.select(number, "ref", F.col("reason").alias("outcome"))
    met = report.sources.select(F.col("ordinal").alias("s_id"), number).join(report.pairs, "s_id")
    return labels.unionByName(met.select("ordinal", "ref", F.concat(F.lit("Matched"), F.col("strategy")).alias("outcome")))


_TRIM = r"regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
_LEDGERS = f"src as ({SOURCE_SQL.format(orders='orders')}), tgt as ({TARGET_SQL.format(orders='orders')})"
_MET = """
    k as (select *, row_number() over (partition by ref, currency order by ordinal) as turn from src),
    met as (select k.ref, k.currency, k.turn, k.ordinal as s_ordinal, t.ordinal as t_ordinal, cast(k.amount * 100 as bigint) as s_cents, cast(t.amount * 100 as bigint) as t_cents,
                   k.value_date as s_day, t.value_date as t_day, abs(date_diff('day', k.value_date, t.value_date)) as days, cast(abs(k.amount - t.amount) * 100 as bigint) as gap
            from k join tgt t on k.ref = t.ref and k.currency = t.currency)
"""
_TEST = {
    "Exact": ("gap = 0 and days = 0", "0", "10000"),
    "Fuzzy": ("(gap <= 500 or (s_cents <> 0 and gap * 200 <= abs(s_cents))) and days <= 3", "-greatest(21000, 28500 - 9 * gap - 1000 * days)", "cast(round(greatest(21000, 28500 - 9 * gap - 1000 * days) / 3.0) as bigint)"),
    "Partial": ("t_cents <> 0 and abs(t_cents) < abs(s_cents) and abs(s_cents) % abs(nullif(t_cents, 0)) = 0", "0", "6000"),
}


def _match_sql(*names: str) -> str:
    """Pairs of ledgers with at most two sources a bucket: the second takes its turn without what the first claimed."""
    case = lambda i: "case " + " ".join(f"when {_TEST[n][0]} then {(j, _TEST[n][1], _TEST[n][2], repr(n))[i]}" for j, n in enumerate(names)) + " end"
    pick = "qualify row_number() over (partition by s_ordinal order by rk, pref, t_ordinal) = 1"
    return f"""
        {_LEDGERS}, {_MET},
        c as (select *, {case(0)} as rk, {case(1)} as pref, {case(2)} as score_bp, {case(3)} as strategy from met),
        one as (select * from c where turn = 1 and rk is not null {pick}),
        two as (select c.* from c left join one using (ref, currency, t_ordinal) where c.turn = 2 and c.rk is not null and one.t_ordinal is null qualify row_number() over (partition by c.s_ordinal order by c.rk, c.pref, c.t_ordinal) = 1),
        pairs as (select ref, currency, s_ordinal, t_ordinal, s_cents, t_cents, cast(s_day as varchar) as s_date, cast(t_day as varchar) as t_date, strategy, score_bp from one
                  union all select ref, currency, s_ordinal, t_ordinal, s_cents, t_cents, cast(s_day as varchar), cast(t_day as varchar), strategy, score_bp from two)
    """


_CASCADE = _match_sql("Exact", "Fuzzy", "Partial")
_TAGS = """
    left_s as (select src.* from src anti join pairs on src.ordinal = pairs.s_ordinal), left_t as (select tgt.* from tgt anti join pairs on tgt.ordinal = pairs.t_ordinal),
"""
_LABELS = """
    g as (select ref, sum(sc) as sc, sum(tc) as tc, sum(ms) as ms, sum(mt) as mt, max(amount) as t_amount, max(value_date) as t_date
          from (select ref, 1 as sc, 0 as tc, 0 as ms, 0 as mt, null as amount, null as value_date from left_s union all select ref, 0, 1, 0, 0, amount, value_date from left_t
                union all select ref, 0, 0, 1, 0, null, null from pairs union all select ref, 0, 0, 0, 1, null, null from pairs) group by ref having sum(sc) + sum(tc) > 0),
    labels as (select ordinal, ref, currency, amount, value_date,
                      case when sc > 1 then 'DuplicateInSource' when sc + ms = 1 and tc + mt > 1 then 'SplitPayment'
                           when tc = 1 and not (sc + ms > 1 and tc + mt = 1) and amount <> t_amount then 'AmountMismatch'
                           when tc = 1 and not (sc + ms > 1 and tc + mt = 1) and value_date <> t_date then 'DateMismatch' else 'MissingInTarget' end as reason from left_s join g using (ref)
               union all select ordinal, ref, currency, amount, value_date,
                      case when tc > 1 then 'DuplicateInTarget' when sc + ms > 1 and tc + mt = 1 then 'ConsolidatedPayment' else 'MissingInSource' end from left_t join g using (ref))
"""
_ALL = f"with {_CASCADE}, {_TAGS} {_LABELS}"
_REF = f"upper(translate({_TRIM.format('reference')}, ' -/', ''))"
_NUMBER = r"regexp_full_match({0}, '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d{{1,2}})?')"


def _amount_sql(table: str, name: str) -> str:
    """CTEs that end in `name`: raw, cents for each distinct amount of a table (lenient reading)."""
    return rf"""
        {name}_m as (select distinct amount as raw, {_TRIM.format("amount")} as t from {table}),
        {name}_v as (select raw, regexp_replace(regexp_replace(case when regexp_matches(t, ',[^.]*$') then translate(t, ',.', '.') else translate(t, ',', '') end, '^\(\s*([^()+-]*?)\s*\)$', '-\1'), '^([^+-]*?)\s*-$', '-\1') as x from {name}_m),
        {name} as (select raw, case when {_NUMBER.format("x")} then cast(round(cast(x as decimal(28,10)), 2) * 100 as bigint) end as cents from {name}_v)
    """


def _normal_sql(table: str, name: str) -> str:
    """CTEs that end in `name`: the rows of a raw table with typed values and the first error, as the normaliser makes them."""
    t, blank = trimmed, lambda c: f"coalesce({trimmed(c)}, '') = ''"
    fields = {"reference": "Reference", "amount": "Amount", "currency": "Currency", "value_date": "ValueDate"}
    quoted = lambda c: f"chr(39) || {c} || chr(39) || '.'"
    required = " ".join(f"when {blank(c)} then '{f} is required.'" for c, f in fields.items())
    ref = f"upper(translate({t('reference')}, ' -/', ''))"
    return f"""
        {_amount_sql(table, f"{name}_amount")}, {dates_sql(f"select value_date as raw from {table}", f"{name}_dates")},
        {name}_r as (select r.*, {ref} as ref, case when length({t('currency')}) = 3 then upper({t('currency')}) end as code, a.cents, v.at_utc as value_at,
                     case {required} when a.cents is null then 'Cannot parse amount ' || {quoted('amount')} when v.at_utc is null then 'Cannot parse date ' || {quoted('value_date')}
                          when {ref} = '' then 'Normalization failed: reference is empty.' when length({t('currency')}) <> 3 then 'Normalization failed: currency has not three characters.' end as error_message,
                     case {' '.join(f"when {blank(c)} then '{f}'" for c, f in fields.items())} when a.cents is null then 'Amount' when v.at_utc is null then 'ValueDate' end as error_field
                     from {table} r left join {name}_amount a on r.amount = a.raw left join {name}_dates v on r.value_date = v.raw),
        {name} as (select *, upper({t("coalesce(description, chr(32))")}) as description_norm, case when contains({t('iban')}, ' ') then upper(replace({t('iban')}, ' ', '')) else {t('iban')} end as iban_norm, {t('counterparty_name')} as name_norm from {name}_r)
    """


def _turns_sql(*names: str) -> str:
    """CTEs that end in pairs: any number of sources a bucket taking turns, one step of the recursion a turn.

    src and tgt have id, ordinal, ref, currency, cents and value_date; ordinals are unique on each side.
    """
    case = lambda i: "case " + " ".join(f"when {_TEST[n][0]} then {(j, _TEST[n][1], _TEST[n][2], repr(n))[i]}" for j, n in enumerate(names)) + " end"
    return f"""
        k as (select *, row_number() over (partition by ref, currency order by ordinal) as turn from src where ref is not null and currency is not null),
        met as (select k.ref, k.currency, k.turn, k.id as s_id, t.id as t_id, k.ordinal as s_ordinal, t.ordinal as t_ordinal, k.cents as s_cents, t.cents as t_cents, k.value_date as s_day, t.value_date as t_day,
                       abs(date_diff('day', k.value_date, t.value_date)) as days, abs(k.cents - t.cents) as gap from k join tgt t on k.ref = t.ref and k.currency = t.currency),
        c as (select * from (select *, {case(0)} as rk, {case(1)} as pref, cast({case(2)} as bigint) as score_bp, {case(3)} as strategy from met) where rk is not null),
        lanes as (select ref, currency, max(turn) as turns from c group by all),
        steps(ref, currency, turn, claimed, s_ordinal, t_ordinal, strategy) as (
            select ref, currency, cast(0 as bigint), cast([] as bigint[]), cast(null as bigint), cast(null as bigint), cast(null as varchar) from lanes
            union all
            select p.ref, p.currency, p.turn + 1, case when c.t_ordinal is null then p.claimed else list_append(p.claimed, c.t_ordinal) end, c.s_ordinal, c.t_ordinal, c.strategy
            from steps p join lanes l on p.ref = l.ref and p.currency = l.currency and p.turn < l.turns
                 left join c on c.ref = p.ref and c.currency = p.currency and c.turn = p.turn + 1 and not list_contains(p.claimed, c.t_ordinal)
            qualify row_number() over (partition by p.ref, p.currency order by c.rk, c.pref, c.t_ordinal) = 1),
        pairs as (select c.ref, c.currency, c.s_id, c.t_id, c.s_ordinal, c.t_ordinal, c.s_cents, c.t_cents, cast(c.s_day as varchar) as s_date, cast(c.t_day as varchar) as t_date, c.strategy, c.score_bp
                  from steps join c on steps.s_ordinal = c.s_ordinal and steps.t_ordinal = c.t_ordinal)
    """


_TXN = "with recursive src as (select *, txn_id as id, cast(amount * 100 as bigint) as cents from txn_source), tgt as (select *, txn_id as id, cast(amount * 100 as bigint) as cents from txn_target), "
_TXN_CASCADE = _TXN + _turns_sql("Exact", "Fuzzy", "Partial")
_NUMBERED = "row_number() over (order by source_file, row_number, ref, code, cents, cast(value_at as date), description_norm, iban_norm, name_norm)"
_RAW_SIDE = lambda name: f"select {_NUMBERED} as id, {_NUMBERED} as ordinal, ref, code as currency, cents, cents / 100.0 as amount, cast(value_at as date) as value_date, source_file, row_number from {name} where error_message is null"
_RAW_RECONCILED = f"""
    with recursive {_normal_sql('raw_txn', 'n')}, {_normal_sql('raw_txn_copy', 'm')}, src as materialized ({_RAW_SIDE('n')}), tgt as materialized ({_RAW_SIDE('m')}), {_turns_sql('Exact', 'Fuzzy', 'Partial')}, {_TAGS}
    {_LABELS.replace('labels as (select ordinal, ref, currency, amount, value_date,', "labels as (select 'S' as side, source_file, row_number,").replace('union all select ordinal, ref, currency, amount, value_date,', "union all select 'T', source_file, row_number,")},
    outcomes as (select side, source_file, row_number, reason as outcome from labels
        union all select 'S', source_file, row_number, 'Matched' || strategy from pairs join src on pairs.s_ordinal = src.ordinal
        union all select 'T', source_file, row_number, 'Matched' || strategy from pairs join tgt on pairs.t_ordinal = tgt.ordinal
        union all select 'S', source_file, row_number, 'Rejected' from n where error_message is not null
        union all select 'T', source_file, row_number, 'Rejected' from m where error_message is not null)
    select side, source_file, row_number, outcome, count(*) as n from outcomes group by all
"""
_TXN_LABELS = _LABELS.replace("select ordinal, ref, currency, amount, value_date,", "select id as txn_id, side, ref, currency,").replace("from left_s join g using (ref)", "from left_s left join g using (ref)").replace("from left_t join g using (ref)", "from left_t left join g using (ref)")

SQL: dict[str, str] = {
    "match_transactions": f"{_TXN_CASCADE} select * from pairs",
    "match_transactions_reordered": f"{_TXN} {_turns_sql('Partial', 'Exact')} select * from pairs",
    "transaction_legs": f"{_TXN_CASCADE}, {_TAGS} {_LABELS} select ref, cast(sc as bigint) as sc, cast(tc as bigint) as tc, cast(ms as bigint) as ms, cast(mt as bigint) as mt from g where ref is not null",
    "classify_transactions": f"{_TXN_CASCADE}, {_TAGS} {_TXN_LABELS.replace('group by ref having', 'where ref is not null group by ref having')} select txn_id, side, ref, currency, reason from labels",
    "reconcile_raw": _RAW_RECONCILED,
    "report_counters": _RAW_RECONCILED.rsplit("select side", 1)[0] + """select (select count(*) from src) as total_source, (select count(*) from tgt) as total_target, (select count(*) from pairs) as matched, count(*) filter (side = 'S' and outcome = 'MatchedExact') as exact_count,
        count(*) filter (side = 'S' and outcome = 'MatchedFuzzy') as fuzzy_count, count(*) filter (side = 'S' and outcome = 'MatchedPartial') as partial_count, (select count(*) from left_s) as unmatched_source, (select count(*) from left_t) as unmatched_target,
        count(*) filter (outcome = 'Rejected') as skipped_rows, count(*) filter (outcome = 'Rejected') as total_errors, count(distinct source_file) filter (outcome = 'Rejected') as dead_letter_files, cast(round((select count(*) from pairs) * 10000.0 / (select count(*) from src)) as bigint) as match_rate_bp from outcomes""",
    "report_page": f"{_TXN_CASCADE} select s_id, t_id, strategy from pairs order by s_ordinal limit 100 offset 100",
    "money_of": over(lambda t: _money(t)),
    "result_chain": over(lambda t: _chained(t)),
    "drafted_options": over(lambda t: _shown(match(*_sides(t), ReconOptions.draft().fuzzy("0.70", "0.95").tolerance(absolute=5).build()), "s_id", "t_id")),
    "files_json": "select reference, amount, currency, value_date, description, iban, counterparty_name, booking_date, row_number, source_file from raw_txn",
    "files_mt940": """select 'ORD' || o_orderkey as reference, case when o_orderkey % 3 = 0 then '-' else '' end || replace(cast(cast(o_totalprice as decimal(18,2)) as varchar), '.', ',') as amount, 'EUR' as currency, '20' || strftime(o_orderdate, '%y%m%d') as value_date,
        o_orderpriority as description, 'DE00' || (o_orderkey // 1000) as iban, cast(row_number() over (partition by o_orderkey // 1000 order by o_orderkey) as int) as row_number from orders""",
    "money_of": f"with {_amount_sql('raw_txn', 'a')} select upper({_TRIM.format('currency')}) as currency, count(*) as n, cast(sum(cents) as bigint) as cents from raw_txn join a on raw_txn.amount = a.raw where cents is not null and length({_TRIM.format('currency')}) = 3 group by 1",
    "result_chain": f"with {_amount_sql('raw_txn', 'a')} select raw_id, case when cents >= 0 then cents // 2 end as half_cents, case when cents is null then 'no number' when cents < 0 then 'below zero' end as message from raw_txn left join a on raw_txn.amount = a.raw",
    "drafted_options": f"{_TXN_CASCADE} select * from pairs",
    "transaction_id_rejects": "select raw_id, coalesce(reference, '') as text from raw_txn where not regexp_full_match(lower(coalesce(reference, '')), '[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}|[0-9a-f]{64}')",
    "match_contended": f"""with recursive src as (select l_orderkey::varchar as ref, 'EUR' as currency, l_orderkey * 1000000 + l_partkey * 10 + l_linenumber as ordinal, l_orderkey * 1000000 + l_partkey * 10 + l_linenumber as id, max(cast(cast(l_quantity as decimal(18,2)) * 100 as bigint)) as cents, max(cast(l_shipdate as date)) as value_date from lineitem group by all),
        tgt as (select * replace (value_date + 20 as value_date) from src), {_turns_sql('Exact', 'Fuzzy', 'Partial')} select ref, s_ordinal, t_ordinal, strategy, score_bp from pairs""",
    "norm_date": f"with {dates_sql('select value_date as raw from raw_txn')} select raw, strftime(at_utc, '%Y-%m-%d %H:%M:%S') as at from dates union all select distinct null, null from raw_txn where value_date is null",
    "norm_full": f"with {_normal_sql('raw_txn', 'n')} select source_file, row_number as source_row_number, ref, code as currency, cents, strftime(value_at, '%Y-%m-%d') as value_date, description_norm as description, iban_norm as iban, name_norm as counterparty_name from n where error_message is null",
    "norm_rejects": f"with {_normal_sql('raw_txn', 'n')} select source_file, row_number, 'INVALID_TRANSACTION' as error_code, error_field, error_message from n where error_message is not null",
    "norm_reference": f"select distinct reference as raw, {_REF} as ref from raw_txn",
    "norm_amount": f"with {_amount_sql('raw_txn', 'amounts')} select raw, cents from amounts",
    "norm_description": f"select distinct description as raw, upper({_TRIM.format('coalesce(description, chr(32))')}) as description from raw_txn",
    "norm_iban": f"select distinct iban as raw, case when contains({_TRIM.format('iban')}, ' ') then upper(replace({_TRIM.format('iban')}, ' ', '')) else {_TRIM.format('iban')} end as iban from raw_txn",
    "norm_currency": f"select distinct currency as raw, case when length({_TRIM.format('currency')}) = 3 then upper({_TRIM.format('currency')}) end as currency from raw_txn",
    "norm_counterparty": f"select distinct counterparty_name as raw, {_TRIM.format('counterparty_name')} as name from raw_txn",
    "money_rounding": "select l_orderkey, l_linenumber, l_partkey, cast(round(cast(l_extendedprice as decimal(18,2)) * cast(l_discount as decimal(4,2)), 2) * 100 as bigint) as cents from lineitem",
    "money_minor_units": "select o_orderkey, cast(cast(o_totalprice as decimal(18,2)) * 10000 as bigint) as units, cast(cast(o_totalprice as decimal(18,2)) * 100 as bigint) as cents from orders",
    "money_sums": f"with {_LINES} select l_orderkey, l_linenumber, c + oc as added, c - oc as taken from n",
    "tolerance_amount": f"with {_LINES} select l_orderkey, l_linenumber, abs(c - oc) <= 100000 or (c <> 0 and abs(c - oc) * 100 <= 10 * abs(c)) as within, abs(c - oc) <= 100000 as absolute, case when c = 0 and oc = 0 then true when c = 0 then false else abs(c - oc) * 100 <= 10 * abs(c) end as percentage from n",
    "tolerance_date": f"with {_LINES} select l_orderkey, l_linenumber, abs(date_diff('day', day, other_day)) <= 30 as within from n",
    "confidence_bands": "with s as (select cast(round(cast(l_discount as decimal(10,4)) * 9, 4) * 10000 as bigint) as score_bp from lineitem) select score_bp, case when score_bp >= 9000 then 'High' when score_bp >= 7000 then 'Medium' else 'Low' end as band, count(*) as n from s group by all",
    "divisibility_decimal": f"with {_LINES} select l_orderkey, l_linenumber, 1250 < abs(c) and abs(c) % 1250 = 0 as splits, c % 5 = 0 as divides from n",
    "divisibility_scaled": f"with {_LINES} select l_orderkey, l_linenumber, 1250 < abs(c) and abs(c) % 1250 = 0 as splits, c % 5 = 0 as divides from n",
    "transaction_ids": "select raw_id, sha256('S' || chr(1) || source_file || chr(1) || row_number) as txn_id, true as valid from raw_txn",
    "index_buckets": f"with {_LEDGERS} select ref, currency, sources, targets from (select ref, currency, count(*) as sources from src group by all) join (select ref, currency, count(*) as targets from tgt group by all) using (ref, currency)",
    "fuzzy_candidates": f"with {_LEDGERS}, {_MET} select ref, currency, s_ordinal, t_ordinal, {_TEST['Fuzzy'][2]} as score_bp from met where {_TEST['Fuzzy'][0]}",
    "partial_candidates": f"with {_LEDGERS}, {_MET} select ref, currency, s_ordinal, t_ordinal, cast(6000 as bigint) as score_bp from met where {_TEST['Partial'][0]}",
    "match_exact": f"with {_match_sql('Exact')} select * replace (cast(score_bp as bigint) as score_bp) from pairs",
    "match_fuzzy": f"with {_match_sql('Fuzzy')} select * replace (cast(score_bp as bigint) as score_bp) from pairs",
    "match_partial": f"with {_match_sql('Partial')} select * replace (cast(score_bp as bigint) as score_bp) from pairs",
    "match_cascade": f"with {_CASCADE} select * replace (cast(score_bp as bigint) as score_bp) from pairs",
    "match_reordered_pipeline": f"with {_match_sql('Partial', 'Exact')} select * replace (cast(score_bp as bigint) as score_bp) from pairs",
    "match_results": f"with {_CASCADE} select ordinal, src.ref, src.currency, t_ordinal, strategy, cast(score_bp as bigint) as score_bp, case when t_ordinal is null then 'Unmatched' else 'Matched' end as kind, case when t_ordinal is null then 'MissingInTarget' end as reason from src left join pairs on src.ordinal = pairs.s_ordinal",
    "unmatched_sources": f"{_ALL} select ordinal, ref, currency from left_s",
    "unmatched_targets": f"{_ALL} select ordinal, ref, currency from left_t",
    "leg_counts": f"{_ALL} select ref, cast(sc as bigint) as sc, cast(tc as bigint) as tc, cast(ms as bigint) as ms, cast(mt as bigint) as mt, cast(sc + ms as bigint) as source_legs, cast(tc + mt as bigint) as target_legs from g",
    **{
        name: f"{_ALL} select ordinal, ref from labels where reason = '{reason.value}'"
        for name, reason in {
            "dup_in_source": Discrepancy.DUPLICATE_IN_SOURCE, "dup_in_target": Discrepancy.DUPLICATE_IN_TARGET, "split_payment": Discrepancy.SPLIT_PAYMENT, "consolidated_payment": Discrepancy.CONSOLIDATED_PAYMENT,
            "amount_mismatch": Discrepancy.AMOUNT_MISMATCH, "date_mismatch": Discrepancy.DATE_MISMATCH, "missing_in_target": Discrepancy.MISSING_IN_TARGET, "missing_in_source": Discrepancy.MISSING_IN_SOURCE,
        }.items()
    },
    "classify_all": f"{_ALL} select ordinal, ref, currency, cast(amount * 100 as bigint) as cents, cast(value_date as varchar) as value_date, reason from labels",
    "classify_ledgers": f"with {_LEDGERS}, left_s as (select * from src), left_t as (select * from tgt), pairs as (select ref from src where false), {_LABELS} select reason, count(*) as n, cast(sum(ordinal) as bigint) as ordinals from labels group by reason",
    "reason_counts": f"{_ALL} select reason, count(*) as n from labels group by reason",
    "match_rate_summary": f"with {_CASCADE} select (select count(*) from src) as total_source, (select count(*) from tgt) as total_target, count(*) as matched, count(*) filter (strategy = 'Exact') as exact_count, count(*) filter (strategy = 'Fuzzy') as fuzzy_count, count(*) filter (strategy = 'Partial') as partial_count, (select count(*) from src) - count(*) as unmatched_source, (select count(*) from tgt) - count(*) as unmatched_target, cast(round(count(*) * 10000.0 / (select count(*) from src)) as bigint) as match_rate_bp from pairs",
    "reconcile_end_to_end": f"{_ALL} select ordinal, ref, reason as outcome from labels union all select s_ordinal, ref, 'Matched' || strategy from pairs",
}
