"""Problem 6: the same payments in two tables without a common key, matched by belief propagation."""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.name_parts import folded
from tallyloom.llm.name_variants import spellings
from tallyloom.llm.name_words import parsed_names, word_meanings
from tallyloom.plans.shared import drop_table, lookup, write_table

ENTRY = ["entry_id", "ref", "currency", "amount", "value_ts", "description", "iban", "counterparty_name"]

#: Levels of each comparison; a pair's levels make its pattern, of which there are at most 5 * 4 * 6 * 4 * 4 * 3.
LEVELS = {
    "number": ("same", "end", "swapped", "none", "other"),
    "money": ("same", "rounded", "less", "other"),
    "days": ("before", "0", "1", "2", "3", "later"),
    "account": ("same", "masked", "none", "other"),
    "party": ("same", "near", "none", "other"),
    "purpose": ("same", "none", "other"),
}
#: Reviewed pairs that the start of the fit uses at most; by smallest ids.
MOST_REVIEWED = 20_000
#: A beginning of words in so many of a side's texts, and this much rarer on the other, is that side's manner of speaking.
COMMON_SHARE, ONE_SIDED = 0.01, 0.05


@dataclass(frozen=True)
class Window:
    """How far two entries of one payment may lie apart: what defines a candidate, so other pairs have no score.

    Days of the statement against the house's; the amount there as a part of the booked one, both taken as fee_room
    larger, which leaves room for fixed fees on small ones; most_fee is such a fee.
    """

    first_day: int = -3
    last_day: int = 7
    least_ratio: float = 0.85
    most_ratio: float = 1.15
    fee_room: float = 60.0
    most_fee: float = 12.0


@dataclass(frozen=True)
class Fit:
    """log odds of a match before any comparison, and what each level adds."""

    prior: float
    weights: dict[str, list[float]]


def _named(book: DataFrame, lines: DataFrame) -> DataFrame:
    """counterparty_name, core, given, n: each distinct name of both tables with its rare word (the longest) and the words it surely has besides, as learnt from all of them."""
    both = book.select("counterparty_name").unionByName(lines.select("counterparty_name"))
    names = write_table(parsed_names(both, "counterparty_name"), "entry-names")
    spelt = spellings(names, word_meanings(names))
    longest = F.array_max(F.transform("cores", lambda w: F.struct(F.length(w).alias("l"), w.alias("w"))))["w"]
    given = F.when(F.col("full"), F.split(F.expr("substring(ident, 3)"), " ")).otherwise(F.array().cast("array<string>"))
    rows = both.where("counterparty_name is not null").groupBy(F.col("counterparty_name").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return write_table(spelt.select("name", longest.alias("core"), given.alias("given")).join(rows, "name").withColumnRenamed("name", "counterparty_name"), "name-words")


def _readied(entries: DataFrame, named: DataFrame, id_name: str) -> DataFrame:
    """Entries with what is compared: rare word of the name and words besides, folded words of the description, document number."""

    @F.pandas_udf("string")
    def plain(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else t.lower() if t.isascii() else folded(t))

    ok = entries.where(" and ".join(f"{c} is not null" for c in ("entry_id", "currency", "amount", "value_ts")))
    digits = F.regexp_extract("description", r"(\d{5,})", 1)
    account = F.upper(F.regexp_replace("iban", r"\s+", ""))
    rows = lookup(ok.select(*ENTRY), named, ["counterparty_name"], ["core", "given"], F.col("entry_id"))
    words = F.coalesce(F.regexp_extract_all(plain("description"), F.lit(r"(\p{L}{4,})"), F.lit(1)), F.array().cast("array<string>"))
    made = rows.select(
        F.col("entry_id").alias(id_name), F.upper(F.trim("currency")).alias("currency"), F.col("amount").cast("double").alias("amount"), F.unix_micros("value_ts").alias("at"),
        F.when(digits != "", digits).alias("number"), F.when(account != "", account).alias("account"), "core", F.coalesce("given", F.array().cast("array<string>")).alias("given"), words.alias("words"),
    )
    return made.withColumn("starts", F.array_distinct(F.transform("words", lambda w: F.left(w, F.lit(4)))))


def _without_manners(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables with starts less the beginnings of words that only one side's texts commonly use: at most a few hundred, as each is in a COMMON_SHARE of its texts."""
    sides = left.select("starts", F.lit(0).alias("side")).unionByName(right.select("starts", F.lit(1).alias("side")))
    n = {r["side"]: r["n"] for r in sides.groupBy("side").agg(F.count(F.lit(1)).alias("n")).collect()}
    per = sides.select(F.explode("starts").alias("w"), "side").groupBy("w").agg(F.count_if(F.col("side") == 0).alias("l"), F.count_if(F.col("side") == 1).alias("r"))
    l, r = F.col("l") / max(n.get(0, 0), 1), F.col("r") / max(n.get(1, 0), 1)
    own = [x["w"] for x in per.where((F.greatest(l, r) >= COMMON_SHARE) & (F.least(l, r) < ONE_SIDED * F.greatest(l, r))).select("w").collect()]
    if not own:
        return left, right
    said = F.array(*map(F.lit, own))
    return left.withColumn("starts", F.array_except("starts", said)), right.withColumn("starts", F.array_except("starts", said))


def line_classes(statement: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one entry per statement line, the one with the smallest id; entry_id, line): a line that stands twice is one line."""
    same = [c for c in ENTRY if c != "entry_id"]
    digest = F.sha2(F.concat(*[F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in same]), 256)
    keyed = statement.where("entry_id is not null").select("entry_id", digest.alias("k"), *same)
    firsts = keyed.groupBy("k").agg(F.min("entry_id").alias("line"))
    members = keyed.select("entry_id", "k").join(firsts, "k").select("entry_id", "line").distinct()
    lines = keyed.join(firsts.select(F.col("line").alias("entry_id")), "entry_id", "left_semi").drop("k").dropDuplicates(["entry_id"])
    return lines, members


def _sorted_digits(number: Column) -> Column:
    return F.array_join(F.array_sort(F.split(number, "")), "")


def _keys(rows: DataFrame, names: Column) -> DataFrame:
    """The values under which entries meet: document number and its end, digits in any order; amount; account's ends; start of the name."""
    number, account = F.col("number"), F.col("account")
    made = F.array(
        F.when(F.length(number) >= 8, F.concat(F.lit("n"), _sorted_digits(number))),
        F.concat(F.lit("e"), _sorted_digits(F.right(number, F.lit(5)))),
        F.concat(F.lit("a"), F.col("amount").cast("decimal(38,2)").cast("string")),
        F.concat(F.lit("i"), F.left(account, F.lit(2)), F.right(account, F.lit(4))),
    )
    named = F.transform(F.filter(names, lambda w: F.length(w) >= 5), lambda w: F.concat(F.lit("c"), F.left(w, F.lit(4))))
    return rows.withColumn("key", F.explode(F.array_distinct(F.concat(F.filter(made, lambda k: k.isNotNull()), named))))


def candidate_pairs(book: DataFrame, lines: DataFrame, window: Window) -> DataFrame:
    """b, s: entries that agree in currency, nearly in day and amount, and in one more field.

    Blocks are of one currency, sign, stretch of days and class of amounts, so a party or account that holds a third of
    all entries still meets only what was paid about then and about so much.
    """
    step, width = math.log(window.most_ratio / window.least_ratio), window.last_day - window.first_day
    log = F.log(F.abs("amount") + window.fee_room)
    day = F.col("at") / F.lit(86_400_000_000)
    place = lambda c, width: F.floor(c / F.lit(width)).cast("bigint")
    left = _keys(book, F.array(F.coalesce("core", F.lit(""))))
    left = left.withColumn("t", F.explode(F.array_distinct(F.array(place(day + window.first_day, width), place(day + window.last_day, width)))))
    left = left.withColumn("m", F.explode(F.array_distinct(F.array(place(log + math.log(window.least_ratio), step), place(log + math.log(window.most_ratio), step)))))
    right = _keys(lines, F.array_union(F.array(F.coalesce("core", F.lit(""))), F.transform("words", lambda w: w))).withColumn("t", place(day, width)).withColumn("m", place(log, step))
    on = ["key", "currency", "sign", "t", "m"]
    left = left.withColumn("sign", F.signum("amount")).select("b", *on, F.col("at").alias("at_b"), F.col("amount").alias("am_b"))
    right = right.withColumn("sign", F.signum("amount")).select("s", *on, "at", "amount")
    days = (F.col("at") - F.col("at_b")) / F.lit(86_400_000_000)
    near = days.between(window.first_day, window.last_day) & ((F.abs("amount") + window.fee_room) / (F.abs("am_b") + window.fee_room)).between(window.least_ratio, window.most_ratio)
    return left.join(right, on).where(near).select("b", "s").distinct()


def _same_name(core: Column, word: Column, near: bool) -> Column:
    """Equal words, one cut off after five letters or more or, if near, with a slip or two."""
    n = F.least(F.length(core), F.length(word))
    if not near:
        return (core == word) | ((n >= 5) & (F.left(core, n) == F.left(word, n)))
    most = F.when(n >= 8, 2).otherwise(1)
    slips = lambda x, y: F.levenshtein(x, y, 2).between(0, most)
    return (n >= 5) & (slips(core, word) | slips(F.left(core, n), F.left(word, n)))


def _party() -> Column:
    """Level of agreement of two parties; a statement without a name may hold the start of one in its text."""
    seen = F.when(F.col("core").isNotNull(), F.array("core")).otherwise(F.filter("words", lambda w: F.length(w) >= 5))
    clash = (F.size("gi_b") > 0) & (F.size("given") > 0) & ~F.arrays_overlap("gi_b", "given")
    level = F.when(F.exists(seen, lambda w: _same_name(F.col("co_b"), w, False)), F.when(F.col("core").isNotNull(), 0).otherwise(1))
    level = level.when(F.exists(seen, lambda w: _same_name(F.col("co_b"), w, True)), 1)
    found = F.when(clash & level.otherwise(-1).isin(0, 1), 3).otherwise(level.when(F.col("core").isNotNull(), 3).otherwise(2))
    return F.when(F.col("co_b").isNull(), 2).otherwise(found)


def compared(pairs: DataFrame, book: DataFrame, lines: DataFrame, window: Window) -> DataFrame:
    """pairs with the level of each comparison."""
    purpose = F.when((F.size("st_b") == 0) | (F.size("starts") == 0), 1).when(F.arrays_overlap("st_b", "starts"), 0).otherwise(2)
    left = book.select("b", F.col("at").alias("at_b"), F.col("amount").alias("am_b"), F.col("number").alias("no_b"), F.col("account").alias("ac_b"), F.col("core").alias("co_b"), F.col("given").alias("gi_b"), F.col("starts").alias("st_b"))
    met = pairs.join(left, "b").join(lines, "s")
    a, b = F.col("no_b"), F.col("number")
    end = (F.least(F.length(a), F.length(b)) >= 5) & (F.length(a) != F.length(b)) & (F.when(F.length(a) > F.length(b), a.endswith(b)).otherwise(b.endswith(a)))
    swapped = (_sorted_digits(a) == _sorted_digits(b)) | ((F.length(a) != F.length(b)) & (_sorted_digits(F.right(a, F.lit(5))) == _sorted_digits(F.right(b, F.lit(5)))))
    number = F.when(a.isNull() | b.isNull(), 3).when(a == b, 0).when(end, 1).when(swapped, 2).otherwise(4)
    ratio, gap = F.try_divide("amount", "am_b"), F.abs(F.col("amount") - F.col("am_b"))
    money = F.when(gap < 0.005, 0).when((gap < 0.055) | (F.abs(ratio - 1) < 0.0003), 1).when((ratio < 1) & ((ratio > 0.9) | (gap < window.most_fee)), 2).otherwise(3)
    gone = (F.col("at") - F.col("at_b")) / F.lit(86_400_000_000)
    days = F.when(gone < 0, F.when(gone > -1.5, 0).otherwise(5)).when(gone < 1, 1).when(gone < 2, 2).when(gone < 3, 3).when(gone < 4.5, 4).otherwise(5)
    p, q = F.col("ac_b"), F.col("account")
    hidden = q.contains("*") & (F.left(p, F.lit(2)) == F.left(q, F.lit(2))) & (F.right(p, F.lit(4)) == F.right(q, F.lit(4))) & (F.length(p) == F.length(q))
    account = F.when(p.isNull() | q.isNull(), 2).when(p == q, 0).when(hidden, 1).otherwise(3)
    return met.select("b", "s", number.alias("number"), money.alias("money"), days.alias("days"), account.alias("account"), _party().alias("party"), purpose.alias("purpose"))


def fit(patterns: pd.DataFrame, reviewed: pd.DataFrame, rounds: int = 200) -> Fit:
    """Fellegi-Sunter weights by expectation-maximisation over the counts of all candidates' patterns.

    patterns has a column per comparison and n; reviewed the patterns of reviewed right pairs, which join the counts of
    matches as they stand. Where there is nothing to count, a start stands that takes agreement for a sign of a match.
    """
    names = list(LEVELS)
    x, n = patterns[names].to_numpy("int64"), patterns["n"].to_numpy("float64")
    good = {"number": [6, 3, 2, 4, 0.3], "money": [8, 2, 2, 0.2], "days": [2, 5, 4, 3, 3, 0.2], "account": [5, 2, 5, 0.2], "party": [5, 4, 4, 0.3], "purpose": [6, 5, 0.3]}
    bad = {"number": [0.02, 0.02, 0.1, 4, 10], "money": [3, 2, 5, 5], "days": [2, 2, 2, 2, 2, 4], "account": [1, 0.5, 5, 8], "party": [1, 1, 3, 8], "purpose": [2, 4, 6]}
    m = {k: np.array(good[k]) / sum(good[k]) for k in names}
    u = {k: np.array(bad[k]) / sum(bad[k]) for k in names}
    share = 0.3
    fixed = {k: np.bincount(reviewed[k].to_numpy("int64"), minlength=len(LEVELS[k])).astype("float64") for k in names}
    for _ in range(rounds if len(x) else 0):
        odds = math.log(share / (1 - share)) + sum(np.log(m[k] / u[k])[x[:, j]] for j, k in enumerate(names))
        r = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
        share = min(0.99, max(1e-4, float((r * n).sum() / n.sum())))
        for j, k in enumerate(names):
            width = len(LEVELS[k])
            mk = np.bincount(x[:, j], r * n, width) + fixed[k] + 2 * np.array(good[k]) / sum(good[k])
            uk = np.bincount(x[:, j], (1 - r) * n, width) + 2 * np.array(bad[k]) / sum(bad[k])
            m[k], u[k] = mk / mk.sum(), uk / uk.sum()
    return Fit(math.log(share / (1 - share)), {k: np.log(m[k] / u[k]).tolist() for k in names})


def propagate(pairs: DataFrame, most_rounds: int = 200, tolerance: float = 1e-4) -> DataFrame:
    """b, s, p: marginal probability of each candidate pair (b, s, odds), each entry being in one pair at most.

    Loopy belief propagation: an entry tells each of its pairs how free it is, 1 / (1 + what its other pairs weigh), from
    what the entries at their other ends told it. Messages pass through joins with each entry's sum, a
    partial aggregate, so no entry's pairs are gathered; rounds end when no probability moves by tolerance. For
    one-to-one factors they converge; should probabilities still move after most_rounds, a warning says so.
    """
    now = pairs.select("b", "s", F.least(F.exp("odds"), F.lit(1e13)).alias("w")).withColumns({"x": F.lit(1.0), "y": F.lit(1.0), "p": F.lit(0.0)})
    table = now = write_table(now, "beliefs")
    for _ in range(most_rounds):
        of_b = now.groupBy("b").agg(F.sum(F.col("w") * F.col("y")).alias("sb"))
        told = now.join(of_b, "b").withColumn("x", 1 / (1 + F.greatest(F.lit(0.0), F.col("sb") - F.col("w") * F.col("y")))).drop("sb")
        of_s = told.groupBy("s").agg(F.sum(F.col("w") * F.col("x")).alias("ss"))
        both = told.join(of_s, "s").withColumn("y", 1 / (1 + F.greatest(F.lit(0.0), F.col("ss") - F.col("w") * F.col("x")))).drop("ss")
        odds = F.col("w") * F.col("x") * F.col("y")
        after = write_table(both.select("b", "s", "w", "x", "y", (odds / (1 + odds)).alias("p"), F.abs(odds / (1 + odds) - F.col("p")).alias("moved")), "beliefs")
        moved = after.agg(F.max("moved")).first()[0]
        drop_table(table)
        table, now = after, after.drop("moved")
        if moved is None or moved < tolerance:
            break
    else:
        warnings.warn(f"probabilities still move by {moved:.2g} after {most_rounds} rounds", stacklevel=2)
    return now.select("b", "s", "p")


def matched_entries(book: DataFrame, statement: DataFrame, reviewed: DataFrame, window: Window | None = None) -> DataFrame:
    """book_entry_id, stmt_entry_id, score: all candidate pairs with the probability that they record the same payment.

    Reviewed pairs (source_id, target_id, score) have the score they were given, whether candidates or not. Each book
    entry is in one pair at most and so is each statement line; a line that stands twice on the statement is one line, and
    all its entries share its scores. Entries without id, currency, amount or time have no candidates; null
    descriptions, accounts and names count for and against nothing. window says how far apart candidates may lie. What
    the words of names mean is learnt from both tables. Empty tables leave the reviewed pairs.
    """
    window = window or Window()
    lines, members = line_classes(statement)
    members = write_table(members, "line-members")
    named = _named(book, lines)
    left, right = write_table(_readied(book.dropDuplicates(["entry_id"]), named, "b"), "book"), write_table(_readied(lines, named, "s"), "lines")
    left, right = _without_manners(left, right)
    levels = write_table(compared(candidate_pairs(left, right, window), left, right, window), "levels")
    counts = levels.groupBy(*LEVELS).agg(F.count(F.lit(1)).alias("n")).toPandas()
    known = reviewed.where("source_id is not null and target_id is not null and score is not null")
    right_pairs = known.where("score >= 0.5").join(members, known["target_id"] == members["entry_id"]).select(F.col("source_id").alias("b"), F.col("line").alias("s")).distinct().orderBy("b", "s").limit(MOST_REVIEWED)
    learnt = fit(counts, levels.join(right_pairs, ["b", "s"], "left_semi").select(*LEVELS).toPandas())
    odds = F.lit(learnt.prior)
    for k, w in learnt.weights.items():
        odds = odds + F.array(*map(F.lit, w))[F.col(k)]
    found = propagate(levels.select("b", "s", odds.alias("odds")))
    scored = found.join(members, found["s"] == members["line"]).select(F.col("b").alias("book_entry_id"), F.col("entry_id").alias("stmt_entry_id"), F.col("p").alias("score"))
    told = known.groupBy(F.col("source_id").alias("book_entry_id"), F.col("target_id").alias("stmt_entry_id")).agg(F.max(F.col("score").cast("double")).alias("told"))
    merged = scored.join(told, ["book_entry_id", "stmt_entry_id"], "full_outer")
    return merged.select("book_entry_id", "stmt_entry_id", F.coalesce("told", "score").alias("score"))
