"""Raw transactions from CSV, JSON and MT940 files, and tables back to files."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.enums import FileFormat
from tallyloom.plans.shared import write_table
from tallyloom.schemas import RAW

CORRUPT = "_corrupt"


class FileTooLargeError(ValueError):
    """A file is larger than the caller allows."""


def _guarded(df: DataFrame, max_file_bytes: int | None) -> DataFrame:
    if max_file_bytes is None:
        return df
    big = df.select("_metadata.file_path", "_metadata.file_size").where(F.col("file_size") > max_file_bytes).select("file_path").distinct().limit(5).collect()
    if big:
        raise FileTooLargeError(f"over {max_file_bytes} bytes: {', '.join(r['file_path'] for r in big)}")
    return df


def read_raw(spark: SparkSession, path: str | list[str], fmt: FileFormat | str, delimiter: str = ",", max_file_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(raw rows, records that couldn't be read) of files; the schema is fixed and nothing is inferred.

    CSV files have one header, the same in all of them, with columns of raw rows in any order; JSON has an object a line. A source_file that
    isn't given is the file's name; where a row_number isn't given, the rows of each file are numbered as they stand in
    it, unreadable ones included. MT940 statements are read whole, a file a record, so max_file_bytes should be
    given for them: each :61: line is a row, with the :86: text behind it as its description. An unknown format is an
    error, as is a file over max_file_bytes. A missing column is null; other columns don't matter.
    """
    fmt = FileFormat(fmt.capitalize() if isinstance(fmt, str) and not isinstance(fmt, FileFormat) else fmt)
    schema = T.StructType([*RAW.fields, T.StructField(CORRUPT, T.StringType())])
    if fmt is FileFormat.CSV:
        # Spark takes columns of CSV by place, so their places are taken from a header; other headers are an error then.
        reader = spark.read.options(header=True, sep=delimiter, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, enforceSchema=False, escape='"', multiLine=False)
        there = reader.csv(path).columns
        df = reader.schema(T.StructType([*[T.StructField(c, T.StringType()) for c in there], T.StructField(CORRUPT, T.StringType())])).csv(path)
        own = {f.name: F.col(f.name).try_cast(f.dataType) if f.name in there else F.lit(None).cast(f.dataType) for f in RAW.fields}
        df = df.select(CORRUPT, "_metadata", *[c.alias(n) for n, c in own.items()])
    elif fmt is FileFormat.JSON:
        df = spark.read.options(mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT).schema(schema).json(path)
    else:
        return _mt940(_guarded(spark.read.text(path, wholetext=True), max_file_bytes))
    named = F.coalesce(F.col("source_file"), F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    df = _positioned(_guarded(df, max_file_bytes).withColumns({"source_file": named, "_path": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"), "_at": F.monotonically_increasing_id()}))
    good = df.where(F.col(CORRUPT).isNull()).select(*RAW.fieldNames())
    bad = df.where(F.col(CORRUPT).isNotNull()).select("source_file", F.col(CORRUPT).alias("record"))
    return good, bad


def _positioned(df: DataFrame) -> DataFrame:
    """Rows with row_number filled in from _path, _block and _at, their place within the scan.

    The places within a part of a file follow one another, so a row's number is its place in its part and the rows of
    the parts before: counts of parts are summed and no file is sorted.
    """
    if df.where("row_number is null").take(1):
        df = write_table(df, "raw-rows")
        parts = df.groupBy("_path", "_block", F.shiftright("_at", 33).alias("_p")).agg(F.min("_at").alias("_low"), F.count(F.lit(1)).alias("_n"))
        before = F.sum("_n").over(Window.partitionBy("_path").orderBy("_block", "_low")) - F.col("_n")
        parts = parts.select(F.col("_path").alias("_q"), F.col("_low"), F.shiftright("_low", 33).alias("_p"), F.col("_block").alias("_b"), before.alias("_before"))
        on = (F.col("_path") == F.col("_q")) & (F.col("_block") == F.col("_b")) & (F.shiftright("_at", 33) == F.col("_p"))
        df = df.join(parts, on).withColumn("row_number", F.coalesce("row_number", (F.col("_before") + F.col("_at") - F.col("_low") + 1).cast("int")))
    return df.drop("_path", "_block", "_at")


#: Value date, optional entry date, debit or credit, optional third letter of the currency, amount, type, reference.
_LINE = r"^(\d{6})(\d{4})?(R?[CD])([A-Z])?(\d+,\d{0,2})[A-Z][A-Z0-9]{3}([^\n/]*)"


def _mt940(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    text = F.regexp_replace("value", r"\r\n?", "\n")
    parts = files.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("source_file"), F.split(text, r"(?m)^:61:").alias("p"))
    head = F.col("p")[0]
    currency = F.regexp_extract(head, r"(?m)^:60[FM]:[CD]\d{6}([A-Z]{3})", 1)
    iban = F.regexp_extract(head, r"(?m)^:25:(?:[^/\n]*/)?([A-Z0-9]+)", 1)
    rows = parts.select("source_file", currency.alias("currency"), iban.alias("iban"), F.posexplode(F.slice("p", 2, F.size("p"))).alias("at", "line"))
    line = F.col("line")
    field = lambda i: F.regexp_extract(line, _LINE, i)
    sign = F.when(field(3).isin("D", "RC"), "-").otherwise("")
    told = F.regexp_extract(line, r"(?ms)^:86:(.*?)(?=^:|^-|\z)", 1)
    booked = F.when(field(2) != "", F.concat(F.lit("20"), F.substring(field(1), 1, 2), field(2)))
    raw = rows.withColumn("ok", line.rlike(_LINE)).select(
        "ok", "line", F.trim(field(6)).alias("reference"), F.concat(sign, field(5)).alias("amount"), "currency", F.concat(F.lit("20"), field(1)).alias("value_date"), F.trim(F.regexp_replace(told, r"\s*\n\s*", " ")).alias("description"),
        F.when(F.col("iban") != "", F.col("iban")).alias("iban"), F.lit(None).cast("string").alias("counterparty_name"), booked.alias("booking_date"), (F.col("at") + 1).cast("int").alias("row_number"), "source_file",
    )
    return raw.where("ok").select(*RAW.fieldNames()), raw.where("not ok").select("source_file", F.col("line").alias("record"))


def results(df: DataFrame) -> Iterator[Row]:
    """Rows one by one, a partition at a time; their order means nothing."""
    return df.toLocalIterator(prefetchPartitions=True)


def batches(df: DataFrame, most: int) -> Iterator[list[Row]]:
    """results in lists of at most `most` rows."""
    if most < 1:
        raise ValueError("a batch has at least one row")
    rows = results(df)
    while batch := list(islice(rows, most)):
        yield batch


def page(df: DataFrame, order: list[str], number: int, size: int = 100) -> DataFrame:
    """The number-th page (from 1) of size rows in the order of the columns given, which should tell all rows apart.

    Spark finds it as a top-k of number * size rows, so it is meant for the first pages of a report.
    """
    if number < 1 or size < 1:
        raise ValueError("pages and their sizes begin at 1")
    return df.orderBy(*order).offset((number - 1) * size).limit(size)
