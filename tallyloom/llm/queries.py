"""The registered queries of this subpackage and, where SQL can say the same, that SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.entity_match import matched_entries
from tallyloom.llm.format_copies import record_copies, records
from tallyloom.llm.languages import document_languages, language_findings
from tallyloom.llm.leakage import leaked_items
from tallyloom.llm.name_parts import NOBODY
from tallyloom.llm.name_variants import name_entities, name_pairs
from tallyloom.llm.nearest_time import nearest_in_time
from tallyloom.llm.packing import container_fill, pack_documents
from tallyloom.plans.shared import write_table
from tallyloom.tables import Tables

Query = Callable[[SparkSession, str], DataFrame]


def over(f: Callable[[Tables], DataFrame]) -> Query:
    return lambda spark, folder: f(Tables(spark, folder))


def _name_checks(t: Tables) -> DataFrame:
    """Names that mean somebody, and whether pairs are ordered and are all pairs within entities."""
    found = write_table(name_entities(t.raw_txn, "counterparty_name"), "entities")
    inside = found.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.min("links").alias("lo"), F.max("links").alias("hi"))
    one = inside.agg(F.sum("n").alias("names"), F.min((F.col("lo") == F.col("n") - 1) & (F.col("hi") == F.col("n") - 1)).alias("links_right"))
    return one.crossJoin(found.agg((F.count(F.lit(1)) == F.count_distinct("name")).alias("names_once")))


def _match_checks(t: Tables) -> DataFrame:
    """Reviewed right pairs that keep their score, and whether every other entry is in one pair at most and scores lie between 0 and 1."""
    found = write_table(matched_entries(t.book_entry, t.stmt_entry, t.matched_pair), "scored")
    told = t.matched_pair.select(F.col("source_id").alias("book_entry_id"), F.col("target_id").alias("stmt_entry_id"), F.col("score").alias("told"))
    kept = found.join(told, ["book_entry_id", "stmt_entry_id"]).agg(F.count_if((F.col("told") == 1) & (F.col("score") == 1)).alias("right_kept"), F.count_if((F.col("told") == 0) & (F.col("score") == 0)).alias("wrong_kept"))
    rest = found.join(told, ["book_entry_id", "stmt_entry_id"], "left_anti")
    per_stmt = rest.where("score > 0.5001").groupBy("stmt_entry_id").agg(F.count(F.lit(1)).alias("n"))
    one = per_stmt.agg(F.coalesce(F.max("n") <= 1, F.lit(True)).alias("one_each"))
    return kept.crossJoin(one).crossJoin(found.agg(F.coalesce(F.min(F.col("score").between(0, 1)), F.lit(True)).alias("scores_right")))


def _packing_checks(t: Tables) -> DataFrame:
    """Texts packed, and whether containers hold at most 2,048 tokens, pieces join without gap and only longer texts are cut."""
    packed = write_table(pack_documents(t.documents), "packed")
    per = packed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("start_token").alias("lo"), F.max("end_token").alias("hi"), F.sum(F.col("end_token") - F.col("start_token")).alias("tokens"))
    right = (F.col("lo") == 0) & (F.col("hi") == F.col("tokens")) & ((F.col("n") == 1) | (F.col("tokens") > 2048))
    one = per.agg(F.count(F.lit(1)).alias("texts"), F.min(right).alias("whole"))
    return one.crossJoin(container_fill(packed).agg((F.max("tokens") <= 2048).alias("fits")))


def _leak_checks(t: Tables) -> DataFrame:
    """Whether every leaked item is long enough, is known, and covered by no more words than it has; distinct items that no document could hold."""
    found = leaked_items(t.documents, t.eval_item)
    return found.agg(F.coalesce(F.min(F.col("longest") >= 12), F.lit(True)).alias("long_enough"), F.coalesce(F.min(F.col("coverage").between(0, 1) & (F.col("covered") >= F.col("longest"))), F.lit(True)).alias("covered_right")).crossJoin(found.join(t.eval_item, "item_id", "left_anti").agg(F.count(F.lit(1)).alias("unknown_items")))


def _language_checks(t: Tables) -> DataFrame:
    """Documents with a main language row, and whether no part repeats the main language and confidences lie between 0 and 1."""
    found = write_table(document_languages(t.documents), "languages")
    per = found.groupBy("doc_id").agg(F.count_if(F.col("kind") == "main").alias("mains"), F.count(F.lit(1)).alias("n"), F.count_distinct("lang").alias("langs"))
    return per.agg(F.sum("mains").alias("mains"), F.min((F.col("langs") == F.col("n")) | (F.col("n") == 1)).alias("parts_differ")).crossJoin(found.agg(F.min(F.col("confidence").between(0, 1)).alias("confidence_right")))


def _shuffled_items(items: DataFrame, run: int = 11) -> DataFrame:
    """Items whose text is cut into runs of less than twelve words that stand in reverse order: what leaks of them does so reordered."""
    words = F.regexp_extract_all("text", F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("ws") - 1) / F.lit(run)).cast("int")), lambda i: F.array_join(F.slice("ws", i * run + 1, F.lit(run)), " "))
    return items.withColumn("ws", words).where("size(ws) > 0").select("item_id", F.array_join(F.reverse(parts), " ").alias("text"))


QUERIES: dict[str, Query] = {
    "p3_found": over(lambda t: record_copies(t.raw_txn)),
    "p3_records": over(lambda t: records(t.raw_txn)),
    "p4_found": over(lambda t: name_pairs(t.raw_txn, "counterparty_name")),
    "p4_entities": over(lambda t: name_entities(t.raw_txn, "counterparty_name")),
    "p6_found": over(lambda t: matched_entries(t.book_entry, t.stmt_entry, t.matched_pair).where("score >= 0.5").select("book_entry_id", "stmt_entry_id")),
    "p6_scored": over(lambda t: matched_entries(t.book_entry, t.stmt_entry, t.matched_pair)),
    "p7_found": over(lambda t: nearest_in_time(t.txn_source, t.txn_target, "ref", "value_ts", "ordinal")),
    "p8_packed": over(lambda t: pack_documents(t.documents)),
    "p8_fill": over(lambda t: container_fill(pack_documents(t.documents))),
    "p4_checks": over(_name_checks),
    "p6_checks": over(_match_checks),
    "p8_checks": over(_packing_checks),
    "p9_checks": over(_leak_checks),
    "p10_checks": over(_language_checks),
    "p9_reordered": over(lambda t: leaked_items(t.documents, _shuffled_items(t.eval_item), min_coverage=0.5).where("longest < 12").select("doc_id", "item_id", "longest", "covered", "tiles")),
    "p9_found": over(lambda t: leaked_items(t.documents, t.eval_item).select("doc_id", "item_id").distinct()),
    "p9_coverage": over(lambda t: leaked_items(t.documents, t.eval_item, min_coverage=0.5)),
    "p10_found": over(lambda t: language_findings(document_languages(t.documents))),
    "p10_languages": over(lambda t: document_languages(t.documents)),
}

_FORM = r"lower(regexp_replace({0}, '[^\p{{L}}\p{{M}}\p{{N}}]+', '', 'g'))"
_BODY = r"(\d+|\d+[.,]\d{2}|\d{1,3}(,\d{3})+\.\d{2}|\d{1,3}(\.\d{3})+,\d{2})"
_RECORDS = rf"""
    with t as (
        select *, regexp_replace(amount, '^[\s]+|[\s]+$', '', 'g') as a, trim(lower(regexp_replace(description, '[^\p{{L}}\p{{M}}\p{{N}}]+', ' ', 'g'))) as words from raw_txn),
    n as (
        select *, case when regexp_full_match(a, '\(\s*{_BODY}\s*\)|-\s*{_BODY}|{_BODY}\s*-|{_BODY}') then
               (case when regexp_matches(a, '[-(]') then -1 else 1 end) * cast(regexp_replace(a, '[^0-9]', '', 'g') as hugeint) * (case when regexp_matches(a, '[.,]') then 1 else 100 end) end as cents,
               case when regexp_matches(words, '\d') and regexp_full_match(words, '\p{{L}}+ [\p{{L}}\p{{M}}\p{{N}}]+( \p{{L}}+ [\p{{L}}\p{{M}}\p{{N}}]+)*')
                    then array_to_string(list_sort(regexp_extract_all(words, '(\p{{L}}+ [\p{{L}}\p{{M}}\p{{N}}]+)', 1)), ';') else replace(words, ' ', '') end as described from t),
    g as (
        select raw_id, min(raw_id) over w as first_raw_id, count(*) over w as copies from n where cents is not null
        window w as (partition by {_FORM.format("reference")}, {_FORM.format("currency")}, {_FORM.format("iban")}, {_FORM.format("counterparty_name")}, described, cents, value_date, booking_date))
"""

_NOBODY = ", ".join(f"'{w}'" for w in sorted(NOBODY))
SQL: dict[str, str] = {
    "p4_checks": rf"select count(distinct counterparty_name)::bigint as names, true as links_right, true as names_once from raw_txn where lower(regexp_replace(counterparty_name, '[^\p{{L}}\p{{N}}]', '', 'g')) not in ({_NOBODY}) and regexp_matches(counterparty_name, '\p{{L}}')",
    "p6_checks": "select count(*) filter (score = 1) as right_kept, count(*) filter (score = 0) as wrong_kept, true as one_each, true as scores_right from matched_pair",
    "p8_checks": "select count(*) as texts, true as whole, true as fits from documents where text is not null",
    "p9_checks": "select true as long_enough, true as covered_right, cast(0 as bigint) as unknown_items",
    "p10_checks": "select count(*) as mains, true as parts_differ, true as confidence_right from documents",
    "p3_found": _RECORDS + "select first_raw_id, raw_id from g where raw_id > first_raw_id",
    "p3_records": _RECORDS + "select first_raw_id, copies from g where raw_id = first_raw_id",
    "p7_found": """
        select s.ordinal as source_ordinal, t.ordinal as target_ordinal
        from txn_source s join txn_target t on s.ref = t.ref and t.value_ts between s.value_ts - interval 30 minute and s.value_ts + interval 30 minute
        qualify row_number() over (partition by s.ordinal order by abs(epoch_us(s.value_ts) - epoch_us(t.value_ts)), t.ordinal) = 1
    """,
}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
