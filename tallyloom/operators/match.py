"""One-to-one matching of sources and targets of the same reference and currency.

Sources take turns in order of ordinal within their bucket (reference, currency). Each runs the whole cascade of strategies:
the first strategy with an eligible target that nobody has claimed gives the pair, and within it the preferred target,
the one with the smallest ordinal among equals. Buckets are independent.

Rows are known by an id: txn_id where a side has it, else ordinal. Order is by ordinal, nulls last, then by id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.enums import Discrepancy, ResultKind
from tallyloom.functions.predicates import divides_scaled
from tallyloom.operators.match_cells import matched_in_cells
from tallyloom.options import ReconOptions
from tallyloom.plans.shared import write_table
from tallyloom.plans.strategies import Exact, Fuzzy, MatchStrategy, Partial, default_pipeline
from tallyloom.schemas import PAIR_COLUMNS

KEY = ["ref", "currency"]
#: Buckets with at most this many combinations are folded whole; larger ones are cut into cells.
FOLD_MOST = 4096
#: Rows that are numbered as one group.
STRETCH = 100_000
_PAIR = "s_id {0}, t_id {1}, s_ordinal bigint, t_ordinal bigint, s_amount decimal(18,2), t_amount decimal(18,2), s_date date, t_date date, strategy string, score decimal(5,4)"
_VALUES = ("last", "ordinal", "id", "amount", "date")


def _slim(rows: DataFrame, id_col: str | None = None) -> DataFrame:
    id_col = id_col or id_column(rows)
    kept = rows.where(F.col("ref").isNotNull() & F.col("currency").isNotNull() & F.col(id_col).isNotNull())
    return kept.select(*KEY, F.col("ordinal").isNull().alias("last"), F.col("ordinal").cast("bigint").alias("ordinal"), F.col(id_col).alias("id"), F.col("amount").cast("decimal(18,2)").alias("amount"), F.col("value_date").alias("date"))


def id_column(rows: DataFrame) -> str:
    return "txn_id" if "txn_id" in rows.columns else "ordinal"


def _types(s: DataFrame, t: DataFrame) -> tuple[str, str]:
    return s.schema["id"].dataType.simpleString(), t.schema["id"].dataType.simpleString()


def _sizes(s: DataFrame, t: DataFrame) -> DataFrame:
    one = F.count(F.lit(1))
    return s.groupBy(*KEY).agg(one.alias("sources")).join(t.groupBy(*KEY).agg(one.alias("targets")), KEY)


def bucket_sizes(source: DataFrame, target: DataFrame) -> DataFrame:
    """ref, currency, sources, targets of every bucket that has both."""
    return _sizes(_slim(source), _slim(target))


def _candidate(x: Column, y: Column, pipeline: Sequence[MatchStrategy], options: ReconOptions) -> Column:
    """Struct that orders the targets y of a source x, smallest first; its rank is null if no strategy takes y."""
    rank = preference = score = name = None
    for i, s in enumerate(pipeline):
        ok = s.eligible(x, y, options)
        values = (F.lit(i), -s.preference(x, y, options).cast("double"), F.round(s.score(x, y, options), 4).cast("decimal(5,4)"), F.lit(s.name))
        rank, preference, score, name = (F.when(ok, v) if old is None else old.when(ok, v) for old, v in zip((rank, preference, score, name), values, strict=True))
    return F.struct(rank.alias("rank"), preference.alias("preference"), *[y[v].alias(v) for v in _VALUES], name.alias("strategy"), score.alias("score"))


def _pair_fields(x: Column, c: Column) -> list[Column]:
    both = [e[v].alias(f"{side}_{v}") for v in ("id", "ordinal", "amount", "date") for side, e in (("s", x), ("t", c))]
    return [*both, c["strategy"].alias("strategy"), c["score"].alias("score")]


def _folded(s: DataFrame, t: DataFrame, pipeline: Sequence[MatchStrategy], options: ReconOptions) -> DataFrame:
    """Buckets of bounded size: a fold over the sources in order, carrying who is claimed."""
    id_type = t.schema["id"].dataType.simpleString()
    pair = _PAIR.format(*_types(s, t)).replace(", ", ",").replace(" ", ":")
    xs = s.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct(*_VALUES))).alias("xs"))
    ys = t.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct(*_VALUES))).alias("ys"))
    start = F.struct(F.array().cast(f"array<{id_type}>").alias("claimed"), F.array().cast(f"array<struct<{pair}>>").alias("pairs"))

    def turn(acc: Column, x: Column) -> Column:
        free = F.filter(F.transform("ys", lambda y: _candidate(x, y, pipeline, options)), lambda c: c["rank"].isNotNull() & ~F.array_contains(acc["claimed"], c["id"]))
        best = F.array_min(free)
        grown = F.struct(F.array_append(acc["claimed"], best["id"]).alias("claimed"), F.array_append(acc["pairs"], F.struct(*_pair_fields(x, best))).alias("pairs"))
        return F.when(F.size(free) == 0, acc).otherwise(grown)

    done = xs.join(ys, KEY).select(*KEY, F.aggregate("xs", start, turn)["pairs"].alias("pairs"))
    return done.select(*KEY, F.inline("pairs"))


def match(source: DataFrame, target: DataFrame, options: ReconOptions | None = None, pipeline: Sequence[MatchStrategy] | None = None, fold_most: int = FOLD_MOST, id_col: str | None = None) -> DataFrame:
    """The matched pairs: ref, currency, ids, ordinals, amounts and dates of both sides, strategy, score (decimal(5,4)).

    source and target need ref, currency, ordinal, amount, value_date and an id that is unique on its side: id_col, by
    default txn_id where a side has it and else ordinal. Each target is in one pair at most. Rows with a null reference, currency or id, or a null amount or
    date where a strategy asks for it, match nothing. An empty pipeline and empty tables give no pairs.

    Buckets of up to fold_most combinations are folded in the JVM. Larger ones are cut into cells of amount and date,
    which are settled in rounds (match_cells), so no task holds a bucket. A pipeline with strategies of one's own,
    which are column functions that may join any two rows of a bucket, folds all buckets whole.
    """
    options, pipeline = options or ReconOptions(), default_pipeline() if pipeline is None else list(pipeline)
    s, t = _slim(source, id_col), _slim(target, id_col)
    if not pipeline:
        return s.sparkSession.createDataFrame([], f"ref string, currency string, {_PAIR.format(*_types(s, t))}").select(*PAIR_COLUMNS)
    own = any(not isinstance(x, Exact | Fuzzy | Partial) or (isinstance(x, Partial) and x.divides not in (Partial().divides, divides_scaled)) for x in pipeline)
    if own:
        return _folded(s, t, pipeline, options).select(*PAIR_COLUMNS)
    hot = write_table(_sizes(s, t).where(F.col("sources") * F.col("targets") > fold_most).select(*KEY), "hot-buckets")
    if not hot.take(1):
        return _folded(s, t, pipeline, options).select(*PAIR_COLUMNS)
    pairs = _folded(s.join(hot, KEY, "left_anti"), t.join(hot, KEY, "left_anti"), pipeline, options)
    large = matched_in_cells(s.join(hot, KEY, "left_semi"), t.join(hot, KEY, "left_semi"), pipeline, options)
    return pairs.select(*PAIR_COLUMNS).unionByName(large.select(*PAIR_COLUMNS))


def numbered(rows: DataFrame, keys: list[str], stretch: int = STRETCH) -> DataFrame:
    """rows (with ordinal and, if it isn't unique, id) with n, the place in their order among the rows alike in keys.

    A group of at most stretch rows is numbered as one. If there are larger ones, rows are numbered within stretches of
    ordinals, each of which is told how many rows come before it.
    """
    order = [F.col("ordinal").asc_nulls_last(), *(["id"] if "id" in rows.columns else [])]
    large = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > stretch)
    if not large.take(1):
        return rows.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    cut = rows.withColumn("_part", F.floor(F.col("ordinal") / F.lit(stretch)))
    counts = cut.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_m"))
    before = counts.withColumn("_before", F.sum("_m").over(Window.partitionBy(*keys).orderBy(F.col("_part").asc_nulls_last())) - F.col("_m")).drop("_m")
    within = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))
    placed = cut.withColumn("_at", within).alias("l").join(before.alias("r"), [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in (*keys, "_part")])
    return placed.select("l.*", "_before").withColumn("n", (F.col("_before") + F.col("_at")).cast("int")).drop("_before", "_at", "_part")


def match_exact(source: DataFrame, target: DataFrame, options: ReconOptions | None = None) -> DataFrame:
    """match with the exact strategy alone, in closed form: the n-th source of an amount and date takes its n-th target.

    Rows alike in reference, currency, amount and date are numbered, large groups of them in stretches of ordinals.
    """
    options = options or ReconOptions()
    same = [*KEY, "amount", "date"]
    side = lambda rows, mark: numbered(_slim(rows), same).drop("last").withColumnsRenamed({"ordinal": f"{mark}_ordinal", "id": f"{mark}_id"})
    met = side(source, "s").join(side(target, "t"), [*same, "n"])
    score = F.lit(str(options.exact_confidence)).cast("decimal(5,4)")
    made = {"s_amount": F.col("amount"), "t_amount": F.col("amount"), "s_date": F.col("date"), "t_date": F.col("date"), "strategy": F.lit(Exact().name), "score": score}
    return met.withColumns(made).select(*PAIR_COLUMNS)


def _left_over(rows: DataFrame, pairs: DataFrame, side: str, id_col: str | None) -> DataFrame:
    id_col = id_col or id_column(rows)
    return rows.join(pairs.select(F.col(f"{side}_id").alias(id_col)), id_col, "left_anti").select(*rows.columns)


def unmatched_sources(source: DataFrame, pairs: DataFrame, id_col: str | None = None) -> DataFrame:
    """Sources in no pair, with reason MissingInTarget; the classifier decides anew."""
    return _left_over(source, pairs, "s", id_col).withColumn("reason", F.lit(Discrepancy.MISSING_IN_TARGET.value))


def unmatched_targets(target: DataFrame, pairs: DataFrame, id_col: str | None = None) -> DataFrame:
    """Targets that nobody claimed."""
    return _left_over(target, pairs, "t", id_col)


def match_results(source: DataFrame, pairs: DataFrame, id_col: str | None = None) -> DataFrame:
    """One row per source: kind Matched with its target, strategy and score, or Unmatched with a reason."""
    met = source.select(F.col(id_col or id_column(source)).alias("s_id"), "ordinal", "ref", "currency").join(pairs.select("s_id", "t_id", "t_ordinal", "strategy", "score"), "s_id", "left")
    hit = F.col("t_id").isNotNull()
    return met.withColumn("kind", F.when(hit, ResultKind.MATCHED.value).otherwise(ResultKind.UNMATCHED.value)).withColumn("reason", F.when(~hit, Discrepancy.MISSING_IN_TARGET.value))
