"""Problem 7: each source row with the target row of the same entity that is nearest in time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.plans.shared import lookup, write_table

#: Cells of a key are this many tolerances long.
CELL_TOLERANCES = 8
#: Cells with at least so many rows are hot.
HOT_ROWS = 20_000
#: Short cells in one tolerance, into which hot cells are cut.
SHORT = 64
#: Rows that one task of the co-group should hold, about.
GROUP_ROWS = 100_000
FOUND = "o bigint, target_ordinal bigint"


def _cell(at: Column, width: int) -> Column:
    return F.floor(at / F.lit(width)).cast("bigint")


def nearest_in_time(source: DataFrame, target: DataFrame, key: str, at: str, ordinal: str, tolerance_s: int = 1800, hot_rows: int = HOT_ROWS) -> DataFrame:
    """source_ordinal, target_ordinal: for each source row the target row of its key nearest in time, before or after.

    Only targets at most tolerance_s away count; at equal distance the one with the smaller ordinal. Rows with a null
    key or time match nothing and rows with a null ordinal are left out; several sources may have one target. Repeated
    source rows come out as often as they occur. Empty tables give an empty result. Keys are compared by 128 bits of hash.

    Hot cells are told by exact counts; their list is joined by Spark's own choice, by broadcast only as long as it is
    small. Both tables are co-grouped by key and time cell. Each target also goes into the cells that its tolerance reaches,
    so every source finds its nearest target inside its own cell, by binary search. Targets of one key and time are
    folded to their smallest ordinal first. Hot cells are cut into short ones of tolerance/SHORT; there sources of
    one key and time are folded too, and looked up afterwards. A short cell thus holds at most its own distinct
    microseconds and, of each short cell within tolerance, the first and the last target: a bound that no skew moves.
    """
    tol = tolerance_s * 1_000_000
    wide, short = tol * CELL_TOLERANCES, max(1, tol // SHORT)

    def taken(df: DataFrame) -> DataFrame:
        df = df.where(F.col(key).isNotNull() & F.col(at).isNotNull() & F.col(ordinal).isNotNull())
        k = F.col(key).cast("string")
        return df.select(F.xxhash64(k).alias("h"), F.xxhash64(F.lit("second"), k).alias("g"), F.unix_micros(at).alias("at"), F.col(ordinal).cast("bigint").alias("o"))

    src, tgt = taken(source), taken(target).groupBy("h", "g", "at").agg(F.min("o").alias("o"))
    total = source.count() + target.count()
    both = taken(source).select("h", "at").unionByName(taken(target).select("h", "at"))
    hot_keys = write_table(both.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= hot_rows).select("h"), "time-keys")
    cells = both.join(hot_keys, "h", "left_semi").groupBy("h", _cell(F.col("at"), wide).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    hot = write_table(cells.where(F.col("n") >= hot_rows).select("h", "c", F.lit(True).alias("hot")), "time-cells")
    any_hot = bool(hot.take(1))
    groups = max(8, total // GROUP_ROWS)

    def marked(rows: DataFrame) -> DataFrame:
        return rows.join(hot, ["h", "c"], "left") if any_hot else rows.withColumn("hot", F.lit(None).cast("boolean"))

    def searched(s: DataFrame, t: DataFrame) -> DataFrame:
        bucket = F.pmod(F.xxhash64("h", "g", "c"), F.lit(groups)).cast("int").alias("bucket")
        cols = [bucket, "h", "g", "c", "at", "o"]
        return s.select(*cols).groupBy("bucket").cogroup(t.select(*cols).groupBy("bucket")).applyInPandas(lambda a, b: _search(a, b, tol), FOUND)

    s = marked(src.withColumn("c", _cell(F.col("at"), wide)))
    reach = F.array_distinct(F.array(_cell(F.col("at") - tol, wide), _cell(F.col("at"), wide), _cell(F.col("at") + tol, wide)))
    t = marked(tgt.withColumn("c", F.explode(reach)))
    found = searched(s.where("hot is null"), t.where("hot is null"))
    if any_hot:
        inside = _cell(F.col("at"), short).alias("c")
        hot_s = s.where("hot")
        times = write_table(hot_s.groupBy("h", "g", "at").agg(F.count(F.lit(1)).alias("n")).withColumn("o", F.xxhash64("h", "g", "at")), "hot-times")
        near = t.where("hot").select("h", "g", "at", "o", inside).distinct()
        ends = near.groupBy("h", "g", "c").agg(F.array_distinct(F.array(F.min(F.struct("at", "o")), F.max(F.struct("at", "o")))).alias("e"))
        ends = ends.select("h", "g", F.explode("e").alias("e"), F.col("c").alias("own"), F.sequence(F.col("c") - SHORT - 1, F.col("c") + SHORT + 1).alias("cs"))
        ends = ends.select("h", "g", F.col("e.at").alias("at"), F.col("e.o").alias("o"), F.explode("cs").alias("c"), "own").where("c <> own").drop("own")
        answers = write_table(searched(times.select("h", "g", "at", "o", inside), near.unionByName(ends)).withColumnRenamed("o", "id"), "hot-answers")
        dictionary = write_table(times.join(answers, times["o"] == answers["id"]).select("h", "g", "at", "n", "target_ordinal"), "hot-times-found")
        served = lookup(hot_s.select("h", "o", F.col("g"), "at").withColumn("key", _joined("h", "g", "at")), dictionary.select(_joined("h", "g", "at").alias("key"), "n", "target_ordinal"), ["key"], ["target_ordinal"], F.col("o"))
        found = found.unionByName(served.where("target_ordinal is not null").select("o", "target_ordinal"))
    return found.select(F.col("o").alias("source_ordinal"), "target_ordinal")


def _joined(*columns: str) -> Column:
    return F.concat_ws(":", *[F.col(c).cast("string") for c in columns])


def _search(a: pd.DataFrame, b: pd.DataFrame, tol: int) -> pd.DataFrame:
    """The nearest row of b for each row of a in the same cell, by one binary search over (cell, time)."""
    if a.empty or b.empty:
        return pd.DataFrame({"o": np.array([], "int64"), "target_ordinal": np.array([], "int64")})
    ids = pd.concat([a[["h", "g", "c"]], b[["h", "g", "c"]]]).groupby(["h", "g", "c"], sort=False).ngroup().to_numpy()
    ca, cb = ids[: len(a)], ids[len(a) :]
    ta, tb, ob = a["at"].to_numpy("int64"), b["at"].to_numpy("int64"), b["o"].to_numpy("int64")
    order = np.lexsort((ob, tb, cb))
    cb, tb, ob = cb[order], tb[order], ob[order]
    # Ranks of times put all cells on one ascending line.
    ranks = np.unique(np.concatenate([ta, tb]))
    line = cb * (len(ranks) + 1) + np.searchsorted(ranks, tb)
    after = np.searchsorted(line, ca * (len(ranks) + 1) + np.searchsorted(ranks, ta))
    far = np.iinfo("int64").max
    best_d, best_o = np.full(len(a), far), np.full(len(a), far)
    for i in (after - 1, after):
        ok = (i >= 0) & (i < len(line))
        i = np.where(ok, i, 0)
        ok &= cb[i] == ca
        d = np.where(ok, np.abs(tb[i] - ta), far)
        better = ok & ((d < best_d) | ((d == best_d) & (ob[i] < best_o)))
        best_d, best_o = np.where(better, d, best_d), np.where(better, ob[i], best_o)
    hit = best_d <= tol
    return pd.DataFrame({"o": a["o"].to_numpy("int64")[hit], "target_ordinal": best_o[hit]})
