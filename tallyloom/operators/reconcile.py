"""Normalise, match, classify and summarise in one run."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.enums import ErrorType, Status, Strategy
from tallyloom.operators.classify import classify, reason_counts
from tallyloom.operators.match import match, unmatched_sources, unmatched_targets
from tallyloom.operators.normalize import normalize
from tallyloom.options import ReconOptions
from tallyloom.plans.shared import spread, write_table
from tallyloom.plans.strategies import MatchStrategy

#: Columns that order the rows of several files, those of the same place by what they say.
ORDER = ["source_file", "source_row_number", "ref", "currency", "amount", "value_date", "description", "iban", "counterparty_name", "txn_id"]


def match_rate(matched: Column, sources: Column) -> Column:
    """Percent of sources matched, two decimals, halves away from zero; 0 without sources."""
    return F.when(sources == 0, F.lit(0)).otherwise(F.round(matched.cast("decimal(20,0)") * 100 / sources.cast("decimal(20,0)"), 2)).cast("decimal(5,2)")


def summary(sources: DataFrame, targets: DataFrame, pairs: DataFrame, rejects: DataFrame | None = None, unreadable: DataFrame | None = None) -> DataFrame:
    """One row of totals: sources, targets, matched by strategy, unmatched by side, skipped rows, errors, files with errors, match rate.

    skipped_rows are rejected rows, total_errors those and the records that could not be read, dead_letter_files the
    files that hold any of them.
    """
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    by = [F.count_if(F.col("strategy") == s.value).alias(f"{s.value.lower()}_count") for s in Strategy]
    one = count(sources, "total_source").crossJoin(count(targets, "total_target")).crossJoin(pairs.agg(F.count(F.lit(1)).alias("matched"), *by))
    bad = [df.select("source_file", F.lit(kind).alias("skipped")) for df, kind in ((rejects, 1), (unreadable, 0)) if df is not None]
    if bad:
        both = bad[0] if len(bad) == 1 else bad[0].unionByName(bad[1])
        per_file = both.groupBy("source_file").agg(F.count(F.lit(1)).alias("n"), F.sum("skipped").alias("skipped"))
        none = F.lit(0).cast("bigint")
        one = one.crossJoin(per_file.agg(F.coalesce(F.sum("skipped"), none).alias("skipped_rows"), F.coalesce(F.sum("n"), none).alias("total_errors"), F.count(F.lit(1)).alias("dead_letter_files")))
    else:
        one = one.withColumns(dict.fromkeys(("skipped_rows", "total_errors", "dead_letter_files"), F.lit(0).cast("bigint")))
    return one.withColumns({"unmatched_source": F.col("total_source") - F.col("matched"), "unmatched_target": F.col("total_target") - F.col("matched"), "match_rate": match_rate(F.col("matched"), F.col("total_source"))})


def error_rows(rejects: DataFrame, unreadable: DataFrame | None = None) -> DataFrame:
    """error_type, source_file, row_number, field, message of every row that was left out."""
    kinds = F.when(F.col("error_field").isin("Amount"), ErrorType.INVALID_AMOUNT.value).when(F.col("error_field") == "ValueDate", ErrorType.INVALID_DATE.value).otherwise(ErrorType.NORMALIZATION_FAILED.value)
    out = rejects.select(kinds.alias("error_type"), "source_file", "row_number", F.col("error_field").alias("field"), F.col("error_message").alias("message"))
    if unreadable is not None:
        out = out.unionByName(unreadable.select(F.lit(ErrorType.MALFORMED_ROW.value).alias("error_type"), "source_file", F.lit(None).cast("int").alias("row_number"), F.lit(None).cast("string").alias("field"), F.col("record").alias("message")))
    return out


@dataclass(frozen=True)
class Progress:
    """How far a run is: the steps done of all, rows matched so far, seconds since it began."""

    job_id: str
    step: str
    done: int
    steps: int
    seconds: float

    @property
    def percent(self) -> float:
        return round(100 * self.done / self.steps, 2)


@dataclass(frozen=True)
class Report:
    """A finished run; tables may be read several times. seconds has the time of each step; sources and targets are the rows that were matched, with the ordinals that pairs name."""

    job_id: str
    status: Status
    pairs: DataFrame
    unmatched: DataFrame
    rejects: DataFrame
    summary: DataFrame
    started_at: datetime
    completed_at: datetime
    seconds: dict[str, float] = field(default_factory=dict)
    sources: DataFrame | None = None
    targets: DataFrame | None = None

    @property
    def reasons(self) -> DataFrame:
        """Unmatched rows by reason."""
        return reason_counts(self.unmatched)

    def write(self, folder: str) -> None:
        """Each table as Parquet under folder."""
        for name in ("pairs", "unmatched", "rejects", "summary"):
            getattr(self, name).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}")


def with_ordinals(rows: DataFrame) -> DataFrame:
    """Transactions, written once, with an ordinal that is unique and follows file and row number, then what the row says.

    Row numbers repeat between files, may be missing, and a row may be delivered twice; ordinals tell all rows apart, so
    they are what rows are known by in a run. Rows are sorted over the cluster by ranges; ordinals have gaps.
    """
    order = [F.col(c).asc_nulls_last() for c in ORDER if c in rows.columns]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return write_table(placed.withColumn("ordinal", F.monotonically_increasing_id()), "transactions")


def reconcile(source: DataFrame, target: DataFrame, options: ReconOptions | None = None, pipeline: Sequence[MatchStrategy] | None = None, raw: bool = True, unreadable: DataFrame | None = None, watch: Callable[[Progress], None] | None = None) -> Report:
    """A run over raw rows of any number of files, or over transactions with raw=False.

    Sources take turns in order of file and row number. With raw=True every row of a side is in a pair, unmatched or
    rejected; rows of one file and row number, and rows without a number, are all kept apart. status is Completed, or
    PartiallyCompleted if rows were rejected; a failure is raised. unreadable (source_file, record) are the records
    that files held besides; they count as errors. watch is told after each step.
    """
    began, clock, job_id = datetime.now(UTC), time.monotonic(), str(uuid.uuid4())
    steps, seconds, last = ("normalize", "match", "classify"), {}, clock

    def told(step: str) -> None:
        nonlocal last
        seconds[step], last = round(time.monotonic() - last, 3), time.monotonic()
        if watch:
            watch(Progress(job_id, step, steps.index(step) + 1, len(steps), round(last - clock, 3)))

    rejects = None
    if raw:
        source, bad_s = normalize(spread(source), "S")
        target, bad_t = normalize(spread(target), "T")
        rejects = write_table(bad_s.withColumn("error_side", F.lit("S")).unionByName(bad_t.withColumn("error_side", F.lit("T"))), "rejects")
    source, target = with_ordinals(source), with_ordinals(target)
    told("normalize")
    pairs = write_table(match(source, target, options, pipeline, id_col="ordinal"), "pairs")
    told("match")
    left = write_table(classify(unmatched_sources(source, pairs, "ordinal").drop("reason"), unmatched_targets(target, pairs, "ordinal"), pairs), "unmatched")
    told("classify")
    bad = any(df is not None and df.take(1) for df in (rejects, unreadable))
    totals = summary(source, target, pairs, rejects, unreadable)
    return Report(job_id, Status.PARTIALLY_COMPLETED if bad else Status.COMPLETED, pairs, left, rejects if rejects is not None else left.limit(0), totals, began, datetime.now(UTC), seconds, source, target)
