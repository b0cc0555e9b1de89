"""What the words of names stand for, learnt from all names: misspellings, short forms and abbreviations.

A word that stands beside many different words (a given name, a word of business) is common. A short form or abbreviation
stands beside the same rare words as what it stands for, name by name: whoever is Bob Gawufeplawu in one place is Robert
Gawufeplawu in another, and so it goes for most Bobs. Counts of that, over all names, tell what a word may mean.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.name_parts import SHORTEST, name_words, resembles, similarity
from tallyloom.plans.shared import write_table

#: A word is common if the words beside it begin in at least so many ways (by two letters), or are so many; so a rare word has few beside it.
SPREAD, MOST_BESIDE = 10, 200
#: Words at most so far apart in a name stand beside one another.
REACH = 8
#: A word stands for a common word if at least this part of the rare words beside it have the other beside them too,
LEAST_SHARE = 0.12
#: if that is at least this part of what its best meaning has,
NEAR_BEST = 0.2
#: if all its meanings together make up this part,
EXPLAINED = 0.5
#: if the two stand together so much more often than chance would have it,
LEAST_LIFT = 3.0
#: and if so many rare words of different beginnings show it, or one where the two words resemble each other.
LEAST_SUPPORT = 2
#: A word one edit from a common word is a misspelling of it if that is so many times as frequent.
TYPO_RATIO = 10


def parsed_names(rows: DataFrame, name_col: str) -> DataFrame:
    """name, words, initials, legal: the distinct texts, taken apart, without nulls and fill-in values."""

    @F.pandas_udf("struct<words:array<string>,initials:array<string>,legal:string>")
    def parts(names: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([name_words(x) or (None, None, None) for x in names], columns=["words", "initials", "legal"])

    names = rows.where(F.col(name_col).isNotNull()).select(F.col(name_col).alias("name")).distinct()
    # Else the optimizer would ask for the words of every row, before rows are made distinct.
    return names.withColumn("p", parts.asNondeterministic()("name")).where("p.words is not null").select("name", "p.*")


def _grams(word: Column) -> Column:
    """The distinct runs of letters of a word, its ends marked, each with its size q.

    One edit spoils at most q + 1 of the runs of q letters. Longer words take longer, more telling runs; a word takes
    part for its own length and for the next shorter one, so words of n and n + 1 letters share the size for n.
    """
    size = lambda n: F.when(n >= 9, 5).when(n >= 7, 4).when(n >= 5, 3).otherwise(2)
    n, padded = F.length(word), F.concat(F.lit("<"), word, F.lit(">"))
    runs = lambda q: F.transform(F.sequence(F.lit(1), n + 3 - q), lambda i: F.struct(q.alias("q"), F.concat(q.cast("string"), F.substring(padded, i, q)).alias("gram")))
    own, less = size(n), size(n - 1)
    return F.array_distinct(F.concat(runs(own), F.when(own != less, runs(less)).otherwise(F.array().cast("array<struct<q:int,gram:string>>"))))


def close_words(words: DataFrame) -> DataFrame:
    """a, b, s: ordered pairs of different words (column word) one edit apart and their similarity. Words with digits are
    numbers, not misspellings of one another.

    A set-similarity join on q-grams with prefix filter: of two words one edit apart that share runs of q letters, each
    has one of the other's q + 2 rarest, so only those are joined, by length too; overlap and edit then decide. Rarity
    is counted over all words.
    """

    @F.pandas_udf("double")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([similarity(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    held = words.where((F.length("word") >= SHORTEST) & ~F.regexp_like("word", F.lit(r"\d"))).select("word", F.explode(_grams(F.col("word"))).alias("g")).select("word", "g.q", "g.gram")
    held = write_table(held, "word-grams")
    ranked = held.join(held.groupBy("gram").agg(F.count(F.lit(1)).alias("df")), "gram")
    rank = F.row_number().over(Window.partitionBy("word", "q").orderBy("df", "gram"))
    prefix = write_table(ranked.withColumn("r", rank).where("r <= q + 2 and df > 1").select("word", "gram", F.length("word").alias("n")), "word-prefixes")
    left = prefix.select(F.col("word").alias("a"), "gram", "n", F.col("n").alias("na"))
    right = prefix.select(F.col("word").alias("b"), "gram", F.explode(F.array("n", F.col("n") - 1)).alias("n"), F.col("n").alias("nb"))
    met = left.join(right, ["gram", "n"]).where((F.col("na") < F.col("nb")) | (F.col("a") < F.col("b"))).select("a", "b").distinct()
    found = write_table(met.where(F.levenshtein("a", "b", 2) >= 0).withColumn("s", alike("a", "b")).where("s > 0"), "close-words")
    return found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b"), "s"))


def word_meanings(names: DataFrame, close: DataFrame | None = None) -> DataFrame:
    """word, n (names that hold it), common, means: the words it may stand for, itself for a common word that stands for no other, null for rare words.

    Counts are over all of names (name, words). close are close_words of their words, found if not given.
    """

    @F.pandas_udf("boolean")
    def look_alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([resembles(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)

    near = F.transform("words", lambda w, i: F.struct(w.alias("word"), F.filter(F.slice("words", F.greatest(i + 1 - REACH, F.lit(1)), F.lit(2 * REACH + 1)), lambda o: o != w).alias("others")))
    held = write_table(names.select("name", F.explode(near).alias("e")).select("name", "e.*"), "name-words")
    counts = held.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    neighbours = write_table(held.select(F.col("word").alias("rare"), F.explode("others").alias("word")).distinct(), "neighbours")
    starts = neighbours.groupBy("rare", F.left("word", F.lit(2))).agg(F.count(F.lit(1)).alias("n")).groupBy(F.col("rare").alias("word")).agg(F.count(F.lit(1)).alias("spread"), F.sum("n").alias("beside"))
    known = write_table(counts.join(starts, "word", "left").select("word", "n", F.coalesce((F.col("spread") >= SPREAD) | (F.col("beside") >= MOST_BESIDE), F.lit(False)).alias("common")), "word-counts")

    beside = write_table(neighbours.join(known.where("not common").select(F.col("word").alias("rare")), "rare", "left_semi"), "beside-rare-words")
    total = beside.select("rare").distinct().count()
    per_word = beside.groupBy("word").agg(F.count(F.lit(1)).alias("rares"))
    pairs = beside.select("rare", F.col("word").alias("x")).join(beside.select("rare", F.col("word").alias("y")), "rare").where("x <> y")
    pairs = pairs.join(known.where("common").select(F.col("word").alias("y")), "y", "left_semi")
    shared = pairs.groupBy("x", "y").agg(F.count(F.lit(1)).alias("both"), F.count_distinct(F.left("rare", F.lit(3))).alias("support"))
    shared = shared.join(per_word.select(F.col("word").alias("x"), F.col("rares").alias("nx")), "x").join(per_word.select(F.col("word").alias("y"), F.col("rares").alias("ny")), "y")
    shared = shared.where((F.col("ny") > F.col("nx")) & (F.col("both") >= LEAST_SHARE * F.col("nx")) & (F.col("both") * F.lit(float(total)) >= LEAST_LIFT * F.col("nx") * F.col("ny")))
    shared = shared.withColumn("alike", look_alike("x", "y")).where((F.col("support") >= LEAST_SUPPORT) | F.col("alike"))
    share = F.col("both") / F.col("nx")
    best = Window.partitionBy("x")
    good = write_table(shared.withColumn("share", share).withColumn("top", F.max("share").over(best)).where(F.col("share") >= NEAR_BEST * F.col("top")).withColumn("all", F.sum("share").over(best)).where(F.col("all") >= EXPLAINED).select("x", "y", "ny"), "meanings")
    # A meaning that has meanings of its own stands for those; after two steps only words without any are left.
    for _ in range(2):
        further = good.select(F.col("x").alias("y"), F.col("y").alias("z"), F.col("ny").alias("nz"))
        good = write_table(good.join(further, "y", "left").select("x", F.coalesce("z", "y").alias("y"), F.coalesce("nz", "ny").alias("ny")).where("x <> y").distinct(), "meanings")
    heads = good.join(good.select(F.col("x").alias("y")).distinct(), "y", "left_anti")
    meant = heads.groupBy(F.col("x").alias("word")).agg(F.array_sort(F.collect_set("y")).alias("learnt"))

    close = close_words(known.select("word")) if close is None else close
    of = lambda mark: known.select(F.col("word").alias(mark), F.col("n").alias(f"n{mark}"), F.col("common").alias(f"c{mark}"))
    typos = close.join(of("a"), "a").join(of("b"), "b").where(F.col("cb") & ~F.col("ca") & (F.col("nb") >= TYPO_RATIO * F.col("na")))
    typos = typos.groupBy(F.col("a").alias("word")).agg(F.max_by("b", F.struct("nb", "b")).alias("right"))
    typos = typos.join(meant.select(F.col("word").alias("right"), F.col("learnt").alias("of_right")), "right", "left").select("word", F.coalesce("of_right", F.array("right")).alias("typo"))
    out = known.join(meant, "word", "left").join(typos, "word", "left")
    return write_table(out.select("word", "n", "common", F.coalesce("typo", "learnt", F.when(F.col("common"), F.array("word"))).alias("means")), "word-meanings")
