"""Problem 4: spellings of names typed by people, linked to the party they mean."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.name_parts import abbreviates, similarity
from tallyloom.llm.name_words import close_words, parsed_names, word_meanings
from tallyloom.plans.components import connected_components
from tallyloom.plans.shared import lookup, write_table

#: Least soft weighted similarity of two spellings of one party.
THRESHOLD = 0.75
#: How far an initial, or one of several words that a short form may stand for, agrees with a word, and an abbreviation seen nowhere else.
INITIAL_AGREES, OPTION_AGREES, SHORT_AGREES = 0.7, 0.9, 0.8
#: So many names are added to their number before the rarity of a word is taken, as few names tell little of it.
FEW_NAMES = 1000


def spellings(names: DataFrame, meanings: DataFrame) -> DataFrame:
    """name, core, words, ident, full, keys, legal of each parsed name, from what its words mean.

    core is the rare words, sorted (the rarest word if all are common); ident the words that the others stand for. A full
    ident is 'w:' and those words. Otherwise ident says what little is known, and keys under which full idents of the
    same core are asked for.
    """
    held = names.select("name", "initials", "legal", F.explode("words").alias("word"))
    told = lookup(held, meanings, ["word"], ["n", "means"], F.col("name"), n="n")
    entry = F.struct("n", "word", "means")
    per = told.groupBy("name").agg(F.first("initials").alias("initials"), F.first("legal").alias("legal"), F.collect_list(entry).alias("e"))
    rare = F.filter("e", lambda x: x["means"].isNull())
    kept = F.when(F.size(rare) > 0, rare).otherwise(F.array(F.array_min("e")))
    split = per.withColumn("kept", kept).withColumn("rest", F.array_except("e", F.col("kept")))
    core = F.array_sort(F.array_distinct(F.transform("kept", lambda x: x["word"])))
    sure = F.array_sort(F.array_distinct(F.transform(F.filter("rest", lambda x: F.size(x["means"]) == 1), lambda x: x["means"][0])))
    vague = F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter("rest", lambda x: F.size(x["means"]) > 1), lambda x: x["means"]))))
    known = split.select("name", "legal", core.alias("cores"), sure.alias("sure"), vague.alias("vague"), F.get("initials", F.lit(0)).alias("initial"))
    tagged = lambda mark, text: F.concat(F.lit(mark), text)
    ident = (
        F.when(F.size("sure") > 0, tagged("w:", F.array_join("sure", " ")))
        .when(F.size("vague") > 0, tagged("o:", F.array_join("vague", " ")))
        .when(F.col("initial").isNotNull(), tagged("i:", F.col("initial")))
        .when(F.col("legal") != "", tagged("l:", F.col("legal")))
        .otherwise("*")
    )
    keys = (
        F.when(F.size("vague") > 0, F.transform("vague", lambda w: tagged("w:", w)))
        .when(F.col("initial").isNotNull(), F.array(tagged("i:", F.col("initial"))))
        .when(F.col("legal") != "", F.array(tagged("l:", F.col("legal"))))
        .otherwise(F.array(F.lit("*")))
    )
    words = F.array_sort(F.array_distinct(F.concat("cores", "sure")))
    return known.select("name", F.array_join("cores", " ").alias("core"), words.alias("words"), (F.size("cores") > 1).alias("odd"), "cores", ident.alias("ident"), F.when(F.col("legal") != "", F.col("legal")).alias("legal"), keys.alias("keys"), (F.size("sure") > 0).alias("full"))


def soft_similarity(a: list[tuple[str, float]], b: list[tuple[str, float]]) -> float:
    """Agreement of two sets of weighted words: what is matched, by equality, one edit or abbreviation, over all weights.

    0 if only one of them has words that the other lacks, as it then merely says more.
    """
    pairs = sorted(((similarity(x, y) or (SHORT_AGREES if abbreviates(x, y) or abbreviates(y, x) else 0.0), max(v, w), x, y) for x, v in a for y, w in b), reverse=True)
    left, right, met, whole = dict(a), dict(b), 0.0, 0.0
    for s, w, x, y in pairs:
        if s and x in left and y in right:
            met, whole = met + s * w, whole + w
            del left[x], right[y]
    if bool(left) != bool(right):
        return 0.0
    return met / max(whole + sum(left.values()) + sum(right.values()), 1e-9)


def _alike_by_words(units: DataFrame, counts: DataFrame, n: int, threshold: float) -> DataFrame:
    """u, v: units of several rare words and others that share one of them, alike in soft similarity of all their words."""

    @F.pandas_udf("double")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        weighed = lambda ws: [(w["word"], w["weight"]) for w in ws]
        return pd.Series([soft_similarity(weighed(x), weighed(y)) for x, y in zip(a, b, strict=True)], dtype="float64")

    odd = units.where("odd")
    anchors = odd.select(F.explode("cores").alias("anchor"), F.col("unit").alias("u"))
    others = units.select(F.explode("cores").alias("anchor"), F.col("unit").alias("v"), F.col("odd").alias("v_odd"))
    pairs = anchors.join(others, "anchor").where((F.col("u") < F.col("v")) | ((F.col("u") > F.col("v")) & ~F.col("v_odd"))).select("u", "v").distinct()
    pairs = write_table(pairs, "word-pairs")
    if not pairs.take(1):
        return pairs
    some = pairs.select(F.col("u").alias("unit")).unionByName(pairs.select(F.col("v").alias("unit"))).distinct()
    words = units.join(some, "unit", "left_semi").select("unit", F.explode("words").alias("word")).join(counts, "word")
    weight = F.log(F.lit(float(n + FEW_NAMES)) / F.col("n"))
    weighed = write_table(words.groupBy("unit").agg(F.collect_list(F.struct("word", weight.alias("weight"))).alias("ws")), "weighed-words")
    met = pairs.join(weighed.select(F.col("unit").alias("u"), F.col("ws").alias("a")), "u").join(weighed.select(F.col("unit").alias("v"), F.col("ws").alias("b")), "v")
    return met.where(alike("a", "b") >= threshold).select("u", "v")


def name_entities(rows: DataFrame, name_col: str, threshold: float = THRESHOLD) -> DataFrame:
    """name, entity, links: every distinct text that names somebody, the party it means, and how many other texts mean it too.

    Texts are compared as they stand; null, fill-in values and texts without letters are left out. Words are taken for
    what they mean among all names (word_meanings): misspellings, short forms and abbreviations of common words are
    learnt from the data. Rare words (surnames, house names) are compared by a set-similarity join on their q-grams.
    Order, case, accents, titles and legal forms don't count. Two spellings mean one party if their words agree in soft
    weighted similarity: agreement of words, each weighted by the logarithm of how rare it is among all spellings, over
    all weights, where words that disagree count on both sides. So equal surnames alone aren't enough. A spelling that
    says less than others (an initial, a short form of several words, only a house name) joins a party only if all that
    it may mean are one. Spellings with several rare words are compared word by word, where an abbreviation seen
    nowhere else counts for its word. More than one edit in a word links only through a spelling between.
    """
    names = write_table(parsed_names(rows, name_col), "names")
    close = close_words(names.select(F.explode("words").alias("word")).distinct())
    meanings = word_meanings(names, close)
    unit = F.concat_ws("\u0001", "core", "ident")
    spelt = write_table(spellings(names, meanings).withColumn("unit", unit), "spellings")
    units = spelt.groupBy("unit").agg(*[F.first(c).alias(c) for c in ("core", "ident", "full", "keys", "words", "cores", "odd")])
    n = spelt.count()
    rarity = lambda df: F.log(F.lit(n + 1.0) / df)
    units = write_table(units, "name-units")
    cores = write_table(units.groupBy("core").agg(rarity(F.count(F.lit(1))).alias("wc")), "core-weights")
    idents = write_table(units.groupBy("ident").agg(rarity(F.count(F.lit(1))).alias("wi")), "ident-weights")
    weighed = write_table(units.join(cores, "core").join(idents, "ident"), "weighed-units")
    both = lambda mark: cores.select(F.col("core").alias(mark))
    pairs = write_table(close.join(both("a"), "a", "left_semi").join(both("b"), "b", "left_semi"), "core-pairs")

    one = weighed.select(F.col("unit").alias("u"), F.col("core").alias("a"), "ident", F.col("wc").alias("wa"), "wi")
    two = weighed.select(F.col("unit").alias("v"), F.col("core").alias("b"), "ident", F.col("wc").alias("wb"))
    score = (F.greatest("wa", "wb") * F.col("s") + F.col("wi")) / (F.greatest("wa", "wb") + F.col("wi"))
    alike = pairs.where("a < b").join(one, "a").join(two, ["b", "ident"]).where(score >= threshold).select("u", "v")
    alike = alike.unionByName(_alike_by_words(units, meanings.select("word", "n"), n, threshold))

    legal = spelt.where("full and legal is not null").select("core", "ident", F.concat(F.lit("l:"), F.col("legal")).alias("key")).distinct()
    full = weighed.where("full")
    single = full.where(~F.col("ident").contains(" "))
    offers = (
        legal.unionByName(single.select("core", "ident", F.col("ident").alias("key")))
        .unionByName(single.select("core", "ident", F.concat(F.lit("i:"), F.substring("ident", 3, 1)).alias("key")))
        .unionByName(full.select("core", "ident", F.lit("*").alias("key")))
    )
    offers = offers.groupBy(F.col("core").alias("b"), "key").agg(F.min("ident").alias("lo"), F.max("ident").alias("hi"))
    vague = weighed.where("not full").select("unit", "core", "wc", F.col("ident").alias("told"), F.explode("keys").alias("key"))
    reach = pairs.unionByName(cores.select(F.col("core").alias("a"), F.col("core").alias("b"), F.lit(1.0).alias("s")))
    asked = vague.join(reach, F.col("core") == F.col("a")).join(offers, ["b", "key"])
    meant = asked.groupBy("unit", "told", "wc").agg(F.min("lo").alias("ident"), F.max("hi").alias("hi"), F.max_by("b", F.struct("s", "b")).alias("b"), F.max("s").alias("s")).where("ident = hi")
    agrees = F.when(F.col("told").startswith("i:"), INITIAL_AGREES).when(F.col("told").startswith("o:"), OPTION_AGREES).otherwise(0.0)
    met = meant.join(idents, "ident")
    score = (F.col("wc") * F.col("s") + F.col("wi") * agrees) / (F.col("wc") + F.col("wi"))
    resolved = met.where((score >= threshold) | F.col("told").rlike(r"^(l:|\*)")).select(F.col("unit").alias("u"), F.concat_ws("\u0001", "b", "ident").alias("v"))

    parts = connected_components(alike.unionByName(resolved), "u", "v")
    placed = spelt.select("name", F.col("unit").alias("node")).join(parts, "node", "left").select("name", F.coalesce("component", "node").alias("entity"))
    sizes = placed.groupBy("entity").agg((F.count(F.lit(1)) - 1).alias("links"))
    return placed.join(sizes, "entity").select("name", "entity", "links")


def name_pairs(rows: DataFrame, name_col: str) -> DataFrame:
    """name_a, name_b (name_a < name_b in byte order): all pairs of distinct texts that mean the same party."""
    found = write_table(name_entities(rows, name_col).where("links > 0").select("name", "entity"), "name-entities")
    a, b = found.select("entity", F.col("name").alias("name_a")), found.select("entity", F.col("name").alias("name_b"))
    return a.join(b, "entity").where("name_a < name_b").select("name_a", "name_b")
