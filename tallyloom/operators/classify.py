"""Leftovers of matching, each with one of eight discrepancies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.enums import Discrepancy as D
from tallyloom.plans.shared import lookup, write_table


#: Hash buckets of references that are counted for skew, and the part of all rows that makes one hot: at most HOT_PART of them are.
BUCKETS, HOT_PART = 100_000, 1000
#: Buckets of fewer rows are never hot.
LEAST_HOT = 10_000
_LEGS = ("sc", "tc", "ms", "mt")


def _tags(unmatched_source: DataFrame, unmatched_target: DataFrame, pairs: DataFrame | None, columns: list[str]) -> DataFrame:
    """All rows and matched legs with ref: columns, null for legs, a one in the count they belong to, and amount and date of targets."""

    def tag(df: DataFrame, ref: str, leg: str) -> DataFrame:
        own = leg in ("sc", "tc")
        kept = [F.col(c) if own else F.lit(None).cast(unmatched_source.schema[c].dataType).alias(c) for c in columns if c != "ref"]
        amount, day = (F.col("amount").cast("decimal(18,2)"), F.col("value_date")) if leg == "tc" else (F.lit(None).cast("decimal(18,2)"), F.lit(None).cast("date"))
        return df.select(F.col(ref).alias("ref"), *kept, *[F.lit(int(c == leg)).cast("bigint").alias(c) for c in _LEGS], amount.alias("t_amount"), day.alias("t_date"))

    tags = tag(unmatched_source, "ref", "sc").unionByName(tag(unmatched_target, "ref", "tc"))
    if pairs is not None:
        s_ref, t_ref = ("s_ref", "t_ref") if "s_ref" in pairs.columns else ("ref", "ref")
        tags = tags.unionByName(tag(pairs, s_ref, "ms")).unionByName(tag(pairs, t_ref, "mt"))
    return tags


def reference_groups(unmatched_source: DataFrame, unmatched_target: DataFrame, pairs: DataFrame | None) -> DataFrame:
    """Per reference: unmatched rows (sc, tc), matched legs (ms, mt), and a target's amount and date for where there is only one.

    pairs has s_ref and t_ref, or ref for both. All is one partial aggregate, so a reference that holds a third of all
    rows costs one row a partition.
    """
    return _grouped(_tags(unmatched_source, unmatched_target, pairs, []))


def _grouped(tags: DataFrame) -> DataFrame:
    found = tags.where(F.col("ref").isNotNull()).groupBy("ref").agg(*[F.sum(c).alias(c) for c in _LEGS], F.max("t_amount").alias("t_amount"), F.max("t_date").alias("t_date"))
    return found.where("sc + tc > 0").withColumn("n", F.col("sc") + F.col("tc"))


def classify(unmatched_source: DataFrame, unmatched_target: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Every unmatched row once, with its reason; both tables have the columns of transactions.

    By reference alone, whatever the currency, the first that holds: several sources: DuplicateInSource; several targets:
    DuplicateInTarget; one source leg in all, matched ones counted, and several target legs: SplitPayment for the
    source; the reverse: ConsolidatedPayment for the target; a source whose one unmatched target isn't a
    consolidation: AmountMismatch, else DateMismatch, if they differ; else MissingInTarget for sources and
    MissingInSource for targets. Mismatches leave their target MissingInSource. Rows without a reference
    are missing on the other side. Empty tables give an empty result; pairs may be left out.

    One shuffle by reference, over which counts are windows. Rows are first counted by hash of reference: where a
    bucket is hot, and for rows without a reference, its rows are looked up in an aggregate instead.
    """
    columns = [c for c in unmatched_source.columns if c != "reason"]
    tags = _tags(unmatched_source, unmatched_target, pairs, columns)
    bucket = F.pmod(F.xxhash64("ref"), F.lit(BUCKETS)).cast("int")
    counts = tags.where(F.col("ref").isNotNull()).groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n"))
    hot = counts.withColumn("all", F.sum("n").over(Window.partitionBy())).where((F.col("n") >= LEAST_HOT) & (F.col("n") * HOT_PART >= F.col("all"))).select("b").collect()
    aside = F.col("ref").isNull() | (bucket.isin([r["b"] for r in hot]) if hot else F.lit(False))
    w = Window.partitionBy("ref")
    cold = tags.where(~aside).select(*columns, F.col("sc").alias("is_s"), (F.col("sc") + F.col("tc")).alias("row"), *[F.sum(c).over(w).alias(c) for c in _LEGS], F.max("t_amount").over(w).alias("t_amount"), F.max("t_date").over(w).alias("t_date"))
    known = cold.where("row = 1").drop("row")
    values = [*_LEGS, "t_amount", "t_date"]
    rows = tags.where(aside & (F.col("sc") + F.col("tc") == 1)).select(*columns, F.col("sc").alias("is_s"))
    if hot:
        groups = write_table(_grouped(tags.where(aside)), "reference-groups")
        known = known.unionByName(lookup(rows, groups, ["ref"], values, F.struct("ordinal", "is_s")))
    else:
        known = known.unionByName(rows.withColumns({v: F.lit(None).cast(known.schema[v].dataType) for v in values}))
    split, whole = "sc + ms = 1 and tc + mt > 1", "sc + ms > 1 and tc + mt = 1"
    of_source = (
        F.when(F.expr("sc > 1"), D.DUPLICATE_IN_SOURCE.value)
        .when(F.expr(split), D.SPLIT_PAYMENT.value)
        .when(F.expr(f"tc = 1 and not ({whole}) and amount <> t_amount"), D.AMOUNT_MISMATCH.value)
        .when(F.expr(f"tc = 1 and not ({whole}) and value_date <> t_date"), D.DATE_MISMATCH.value)
        .otherwise(D.MISSING_IN_TARGET.value)
    )
    of_target = F.when(F.expr("tc > 1"), D.DUPLICATE_IN_TARGET.value).when(F.expr(whole), D.CONSOLIDATED_PAYMENT.value).otherwise(D.MISSING_IN_SOURCE.value)
    return known.select(*columns, F.when(F.col("is_s") == 1, of_source).otherwise(of_target).alias("reason"))


def reason_counts(classified: DataFrame) -> DataFrame:
    return classified.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
