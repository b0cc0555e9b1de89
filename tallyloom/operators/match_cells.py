"""Large buckets of the matcher, cut into cells of amount and date and settled in rounds.

A source can take only targets in reach: equal or near in amount and date, or a part of its amount. So a bucket is cut into
cells, a source lies in one of them, and each target is seen from every cell that has it in reach. In a round each
group of cells lets its sources take turns over the targets they see, leaving out those that an earlier source of another
group took in the round before. The earliest source decides rightly in the first round, every next one at the latest a
round after all before it, and when a round changes nothing, every source has decided knowing what all earlier ones did:
the result of taking turns one by one. In practice rounds are few, as only neighbouring cells contend.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.divisors import divisors
from tallyloom.operators.turns import LAST, NO_DAY, Pool, score_of, take_turns
from tallyloom.options import ReconOptions, ToleranceRule
from tallyloom.plans.shared import drop_table, write_table
from tallyloom.plans.strategies import MatchStrategy, Partial

KEY = ["ref", "currency"]
CELL = ["ac", "dc"]
#: Sources that one group of cells should hold, about; neighbouring cells, so many of amount and of date, go to one group.
GROUP_ROWS, BLOCK = 20_000, (16, 4)
#: From this percentage on amounts don't cut a bucket, as nearly all are within tolerance of one another.
WIDEST_PERCENTAGE = 50
#: Width of a cell in tolerances, a little more than one on each side of a source.
REACH = 1.02


def _scale(cents: Column, rule: ToleranceRule) -> Column:
    """Amounts on a scale on which two within tolerance are less than REACH apart: even up to where the percentage takes over, logarithmic beyond."""
    if rule.percentage >= WIDEST_PERCENTAGE:
        return F.lit(0.0)
    step = max(float(rule.absolute) * 100, 1.0)
    size = F.abs(cents).cast("double")
    if not rule.percentage:
        return F.signum(cents.cast("double")) * size / step
    part = float(rule.percentage) / 100
    turn = step / part
    beyond = turn / step + F.log(F.greatest(size, F.lit(turn)) / turn) / -math.log(1 - part)
    return F.signum(cents.cast("double")) * F.when(size <= turn, size / step).otherwise(beyond)


def _cell(value: Column, width: float) -> Column:
    return F.floor(value / F.lit(width)).cast("bigint")


def _group(groups: int) -> Column:
    return F.pmod(F.xxhash64(*KEY, *[F.floor(F.col(c) / F.lit(n)) for c, n in zip(CELL, BLOCK, strict=True)]), F.lit(groups)).cast("int")


def _sources(s: DataFrame, rule: ToleranceRule, groups: int) -> DataFrame:
    day = F.coalesce(F.datediff("date", F.lit("1970-01-01").cast("date")), F.lit(NO_DAY))
    ready = s.where("amount is not null").select(*KEY, "id", F.coalesce("ordinal", F.lit(LAST)).alias("ordinal"), (F.col("amount") * 100).cast("bigint").alias("cents"), day.cast("bigint").alias("day"))
    placed = ready.withColumn("ac", _cell(_scale(F.col("cents"), rule), 2 * REACH)).withColumn("dc", _cell(F.col("day"), 2 * rule.date_window_days + 1))
    return placed.withColumn("g", _group(groups))


def _seen(t: DataFrame, sources: DataFrame, pipeline: Sequence[MatchStrategy], rule: ToleranceRule, groups: int) -> DataFrame:
    """Targets, each once for every cell that has it in reach and holds a source."""
    ready = _sources(t, rule, 1).drop("g", *CELL)
    near, w = _scale(F.col("cents"), rule), rule.date_window_days
    acs = F.array_distinct(F.array(_cell(near - REACH, 2 * REACH), _cell(near + REACH, 2 * REACH)))
    dcs = F.array_distinct(F.array(_cell(F.col("day") - w, 2 * w + 1), _cell(F.col("day") + w, 2 * w + 1)))
    cells = sources.select(*KEY, *CELL).distinct()
    seen = ready.where(F.col("day") != NO_DAY).withColumn("ac", F.explode(acs)).withColumn("dc", F.explode(dcs)).join(cells, [*KEY, *CELL], "left_semi")
    if any(isinstance(p, Partial) for p in pipeline):

        @F.pandas_udf("array<bigint>")
        def parts(sizes: pd.Series) -> pd.Series:
            return pd.Series([[d for d in divisors(int(n)) if d < abs(n)] for n in sizes])

        whole = sources.select(*KEY, F.abs("cents").alias("whole"), *CELL).where("whole > 1").distinct()
        split = whole.select(*KEY, "whole").distinct().withColumn("size", F.explode(parts("whole")))
        sizes = ready.select(*KEY, F.abs("cents").alias("size")).where("size > 0").distinct()
        met = write_table(split.join(sizes, [*KEY, "size"]), "parts-of-amounts")
        by_cell = met.join(whole, [*KEY, "whole"]).select(*KEY, *CELL, "size").distinct()
        seen = seen.unionByName(ready.withColumn("size", F.abs("cents")).join(by_cell, [*KEY, "size"]).select(*seen.columns)).distinct()
    return seen.withColumn("g", _group(groups))


def matched_in_cells(s: DataFrame, t: DataFrame, pipeline: Sequence[MatchStrategy], options: ReconOptions, group_rows: int | None = None) -> DataFrame:
    """The pairs of buckets s and t (ref, currency, ordinal, id, amount, date) under the strategies Exact, Fuzzy and Partial."""
    rule = options.tolerance
    s_type, t_type = s.schema["id"].dataType.simpleString(), t.schema["id"].dataType.simpleString()
    groups = max(1, -(-s.count() // (group_rows or GROUP_ROWS)))
    sources = write_table(_sources(s, rule, groups), "cell-sources")
    targets = write_table(_seen(t, sources, pipeline, rule, groups), "cell-targets")
    claim = f"ref string, currency string, g int, s_id {s_type}, t_id {t_type}, s_ordinal bigint, t_ordinal bigint, s_cents bigint, t_cents bigint, s_day bigint, t_day bigint, strategy string, score decimal(5,4)"

    def settle(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        columns = [c.split()[0] for c in claim.split(", ")]
        if a.empty or b.empty:
            return pd.DataFrame(columns=columns)
        pools, frames = {}, {}
        for key, own in b.groupby([*KEY, *CELL], sort=False):
            held = [None if g is None or pd.isna(g) or g == own["g"].iloc[0] else (int(o), x) for g, o, x in zip(own["h_g"], own["h_ordinal"], own["h_id"], strict=True)]
            pools[key] = Pool(own["ordinal"].to_numpy("int64"), own["id"].to_numpy(), own["cents"].tolist(), own["day"].to_numpy("int64"), held)
            frames[key] = own
        rows = [(n, (*key,), o, x, c, d) for n, (*key, o, x, c, d) in enumerate(zip(*[a[c].tolist() for c in (*KEY, *CELL, "ordinal", "id", "cents", "day")], strict=True))]
        found = []
        for n, key, k, name, cost in take_turns(rows, pools, pipeline, options):
            x, y = rows[n], frames[key].iloc[pools[key].rows[k]]
            found.append((key[0], key[1], int(a["g"].iloc[0]), x[3], y["id"], x[2], int(y["ordinal"]), x[4], int(y["cents"]), x[5], int(y["day"]), name, score_of(name, cost, options)))
        return pd.DataFrame(found, columns=columns)

    claims, mark = None, None
    while True:
        seen = targets.withColumns({"h_g": F.lit(None).cast("int"), "h_ordinal": F.lit(None).cast("bigint"), "h_id": F.lit(None).cast(s_type)})
        if claims is not None:
            first = claims.groupBy(*KEY, F.col("t_id").alias("id")).agg(F.min(F.struct("s_ordinal", "s_id", "g")).alias("h"))
            seen = targets.join(first, [*KEY, "id"], "left").select(*targets.columns, F.col("h.g").alias("h_g"), F.col("h.s_ordinal").alias("h_ordinal"), F.col("h.s_id").alias("h_id"))
        after = write_table(sources.groupBy("g").cogroup(seen.groupBy("g")).applyInPandas(settle, claim), "claims")
        now = tuple(after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("s_id", "t_id", "strategy").cast("decimal(38,0)"))).first())
        drop_table(claims)
        claims = after
        if now == mark or groups == 1:
            break
        mark = now
    day = lambda c: F.when(F.col(c) != NO_DAY, F.date_add(F.lit("1970-01-01").cast("date"), F.col(c).cast("int")))
    money = lambda c: (F.col(c).cast("decimal(20,0)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(18,2)")
    known = lambda c: F.when(F.col(c) != LAST, F.col(c))
    return claims.select(*KEY, "s_id", "t_id", known("s_ordinal").alias("s_ordinal"), known("t_ordinal").alias("t_ordinal"), money("s_cents").alias("s_amount"), money("t_cents").alias("t_amount"), day("s_day").alias("s_date"), day("t_day").alias("t_date"), "strategy", "score")
