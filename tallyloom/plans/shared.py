"""Intermediate tables in the folder all executors share, and lookups that stand skewed keys."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: A table with less than so many bytes a core is dealt out.
SMALL_PART = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where Spark runs in a single local JVM."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "local[*]")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="tallyloom-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


def write_table(df: DataFrame, label: str) -> DataFrame:
    """Writes df once and reads it back: lineage ends here, and a lost executor costs only a reread."""
    spark = df.sparkSession
    path = f"{own_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_at = path
    return table


def drop_table(table: DataFrame | None) -> None:
    """Deletes what write_table wrote for table itself, for loops that need only their last table; other frames are left alone."""
    if path := getattr(table, "_written_at", None):
        _delete(table.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def own_folder(spark: SparkSession) -> str:
    """Where this application writes, in the folder that all executors share."""
    return f"{shared_dir(spark)}/tallyloom/{spark.sparkContext.applicationId}"


def drop_tables(spark: SparkSession) -> None:
    """Deletes the tables this application has written; frames that were made from them can't be read afterwards."""
    _delete(spark, own_folder(spark))


def spread(df: DataFrame) -> DataFrame:
    """df itself, or, if all it reads are fewer files than there are cores (a small table), its rows dealt out to all of them."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().optimizedPlan()
    small = int(str(plan.stats().sizeInBytes())) < cores * SMALL_PART
    return df.repartition(cores) if small and 0 < len(df._jdf.inputFiles()) < cores else df


def hot_keys(counts: DataFrame, n: str = "n", most: int = 1000) -> DataFrame | None:
    """The rows of counts (one per key, exact) whose key holds at least a `most`-th of all rows: never more than `most` of them, None for none."""
    all_rows, largest = counts.agg(F.sum(n), F.max(n)).first()
    least = max(2.0, (all_rows or 0) / most)
    return counts.where(F.col(n) >= least) if (largest or 0) >= least else None


def lookup(rows: DataFrame, dictionary: DataFrame, keys: list[str], values: list[str], spread: Column, n: str = "n", most: int = 1000) -> DataFrame:
    """rows with the dictionary's values, null where it has no entry.

    dictionary has one row per key with its number of rows in n and should be a written table. Keys that hold a
    `most`-th of all rows or more (at most `most` of them, so their broadcast is bounded if key length is) are
    looked up without a shuffle; the rows so served pass the following shuffled join under a salt made of
    spread, an expression that differs between rows, instead of under their key. Without such keys it is one join.
    """
    hot_rows = hot_keys(dictionary, n, most)
    cold = dictionary.select(*[F.col(k).alias(f"_c_{k}") for k in keys], *[F.col(v).alias(f"_cv_{v}") for v in values])
    salt = F.concat(F.lit("\u0000"), F.pmod(F.xxhash64(spread), F.lit(1_000_003)).cast("string"))
    if hot_rows is None:
        # A null key, however many rows have it, has no entry and passes under a salt too.
        met = rows.withColumn("_salt", F.coalesce(F.col(keys[-1]), salt))
        value = lambda v: F.col(f"_cv_{v}")
    else:
        hot = hot_rows.select(*[F.col(k).alias(f"_h_{k}") for k in keys], *[F.col(v).alias(f"_hv_{v}") for v in values], F.lit(True).alias("_hot"))
        on_hot = reduce(Column.__and__, [F.col(k) == F.col(f"_h_{k}") for k in keys])
        met = rows.join(F.broadcast(hot), on_hot, "left").withColumn("_salt", F.when(F.col("_hot"), salt).otherwise(F.coalesce(F.col(keys[-1]), salt)))
        value = lambda v: F.when(F.col("_hot"), F.col(f"_hv_{v}")).otherwise(F.col(f"_cv_{v}"))
    on_cold = reduce(Column.__and__, [F.col(k) == F.col(f"_c_{k}") for k in keys[:-1]], F.col("_salt") == F.col(f"_c_{keys[-1]}"))
    both = met.join(cold, on_cold, "left")
    return both.select(*[rows[c] for c in rows.columns], *[value(v).alias(v) for v in values])
