"""Problem 2: timestamps in mixed formats and zones, normalised through a dictionary of distinct texts."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions.amounts import short_key
from tallyloom.functions.instants import label_map, moment_form
from tallyloom.plans.shared import lookup, shared_dir, write_table

FIELD, VALUE, FEED, KEY = "_field", "_value", "_feed", "_key"
#: Name of the way texts are read; another one makes what is kept worthless.
FORMAT = "v2"
#: Feeds up to this number are broadcast.
MOST_FEEDS = 10_000


def feed_of(source_file: Column) -> Column:
    """The text before the first underscore of a file name; the whole name if there is none."""
    return F.substring_index(source_file, "_", 1)


def one_per_feed(feed_info: DataFrame, *more: str) -> DataFrame:
    """feed, date_order, tz_name and more, one row for each feed (of repeated ones the smallest values win); null feeds are left out."""
    cols = ["tz_name", "date_order", *more]
    return feed_info.where(F.col("feed").isNotNull()).groupBy(F.col("feed").alias(FEED)).agg(F.min(F.struct(*cols)).alias("_i")).select(FEED, *[F.col(f"_i.{c}").alias(f"_{c}") for c in cols])


class InstantDictionary:
    """Every distinct (feed, text) with its normal form, parsed once. Texts are told apart without white space at their ends.

    With a path, the dictionary is kept there: update() parses only the texts it doesn't hold yet and adds them as
    one more batch, so a daily load pays for its new texts alone. What is kept belongs to one state of feed_info and
    zone_label, under a name made from it, as another date order or zone reads the same text otherwise. A batch counts
    only once its job has committed (a _SUCCESS file); what an interrupted job leaves behind is not read. Without a
    path it lives in the shared folder for this run.
    """

    SCHEMA = T.StructType([T.StructField(FEED, T.StringType()), T.StructField(KEY, T.StringType()), T.StructField("norm", T.StringType()), T.StructField("real", T.BooleanType())])

    def __init__(self, feed_info: DataFrame, zone_label: DataFrame, path: str | None = None):
        self.spark, self.feeds, self.labels = feed_info.sparkSession, one_per_feed(feed_info), label_map(zone_label)
        self.path = f"{path.rstrip('/')}/{FORMAT}-{self._state()}" if path else None

    def _state(self) -> str:
        """A digest of what texts are read by."""
        told = self.feeds.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*self.feeds.columns).cast("decimal(38,0)"))).first()
        return hashlib.sha256(repr((tuple(told), sorted(self.labels.items()))).encode()).hexdigest()[:16]

    def _batches(self) -> list[str]:
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        found = [s.getPath().toString() for s in fs.listStatus(root) if s.isDirectory()]
        return [p for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{p}/_SUCCESS"))]

    def stored(self) -> DataFrame:
        """What the path holds; a text that two concurrent runs added counts once."""
        batches = self._batches() if self.path else []
        if not batches:
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(*batches).groupBy(FEED, KEY).agg(F.min("norm").alias("norm"), F.max("real").alias("real"))

    def parse(self, counts: DataFrame) -> DataFrame:
        """counts (feed, key, text, ...) with columns norm and real instead of the text."""
        known = counts.join(F.broadcast(self.feeds), FEED, "left") if self.feeds.count() <= MOST_FEEDS else counts.join(self.feeds, FEED, "left")
        read = known.withColumn("_m", moment_form(F.col(VALUE), F.col("_date_order"), F.col("_tz_name"), self.labels))
        return read.withColumns({"norm": F.col("_m.norm"), "real": F.col("_m.real")}).drop("_date_order", "_tz_name", "_m", VALUE)

    def update(self, values: DataFrame) -> DataFrame:
        """The dictionary's rows for values (feed, text): feed, key, n (rows that have it), norm, real."""
        known = values.where(F.col(FEED).isNotNull() & F.col(VALUE).isNotNull()).select(FEED, short_key(F.col(VALUE)).alias(KEY), F.col(VALUE))
        counts = known.groupBy(FEED, KEY).agg(F.count(F.lit(1)).alias("n"), F.min(VALUE).alias(VALUE))
        if not self.path:
            return write_table(self.parse(counts), "instants")
        batch, batches = f"{self.path}/batch-{uuid.uuid4().hex}", self._batches()
        if not batches:
            # The first batch is the dictionary itself; its counts are those of this load and are read by nobody else.
            parsed = self.parse(counts)
            parsed.write.parquet(batch)
            return self.spark.read.schema(parsed.schema).parquet(batch)
        counts = write_table(counts, "instant-texts")
        fresh = write_table(counts.join(self.spark.read.schema(self.SCHEMA).parquet(*batches).select(FEED, KEY), [FEED, KEY], "left_anti"), "instant-texts")
        if fresh.take(1):
            self.parse(fresh).select(FEED, KEY, "norm", "real").write.parquet(batch)
        return write_table(counts.drop(VALUE).join(self.stored(), [FEED, KEY]), "instants")


def with_instants(rows: DataFrame, text_col: str, dictionary: DataFrame, made: str, salt: Column) -> DataFrame:
    """rows (with a feed) with column made: the normal form of text_col in a dictionary's rows, null if it has none."""
    keyed = rows.withColumn(KEY, short_key(F.col(text_col)))
    return lookup(keyed, dictionary, [FEED, KEY], ["norm"], salt).withColumnRenamed("norm", made).drop(KEY)


def kept_dictionary(spark: SparkSession, data: str) -> str:
    """Where the registered queries keep the dictionary of a data folder, for its later loads: in the folder that all executors share."""
    return f"{shared_dir(spark)}/tallyloom/instants-{hashlib.sha256(data.encode()).hexdigest()[:16]}"


def normalise_timestamps(rows: DataFrame, id_col: str, fields: list[str], feed_info: DataFrame, zone_label: DataFrame, path: str | None = None) -> DataFrame:
    """One row (id, field, value, norm) for each non-null value of each field; norm is null where the text names no single real date or instant.

    The feed of a row is taken from source_file. A feed that feed_info lacks has no zone and no date order: texts
    that need neither are still read. Null ids are kept. Repeated rows come out as often as they occur. path keeps the
    dictionary of texts for later runs.
    """
    long = rows.select(F.col(id_col).alias("_id"), feed_of(F.col("source_file")).alias(FEED), F.explode(F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*map(F.col, fields)))).alias(FIELD, VALUE))
    long = long.where(F.col(VALUE).isNotNull())
    dictionary = InstantDictionary(feed_info, zone_label, path).update(long.select(FEED, VALUE))
    found = with_instants(long, VALUE, dictionary, "_norm", F.struct("_id", FIELD))
    return found.select(F.col("_id").alias(id_col), F.col(FIELD).alias("field"), F.col(VALUE).alias("value"), F.col("_norm").alias("norm"))


def changed_timestamps(rows: DataFrame, id_col: str, fields: list[str], feed_info: DataFrame, zone_label: DataFrame, path: str | None = None) -> DataFrame:
    """(id, field, norm) for the values that have a normal form and aren't written in it yet."""
    found = normalise_timestamps(rows, id_col, fields, feed_info, zone_label, path)
    return found.where(F.col("norm") != F.col("value")).select(id_col, "field", "norm")
