"""Problem 9: passages of evaluation items inside documents, by greedy string tiling.

Documents are decoded and cut into words once. What leaves that pass are the stretches of a document whose runs of words an
item may have, told by a bitmap of bounded size; those are joined with the items by the hashes of their runs, and tiles
are laid for each document and item that share one.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.mail import text_bodies
from tallyloom.plans.shared import spread, write_table

WORD = re.compile(r"[^\W_]+")
#: The bitmap has so many bits for each run of an item, and between these numbers of bits (powers of two) in all; beyond, more stretches leave a task and are dropped by the join.
BITS_A_RUN, LEAST_BITS, MOST_BITS = 64, 1 << 24, 1 << 27
#: Characters of documents that are worked on at a time within a task; a longer document stands alone.
CHUNK_CHARS = 2_000_000
#: Words whose hashes a task keeps.
MOST_CACHED = 1_000_000
#: Characters without width, which may stand inside a word.
UNSEEN = dict.fromkeys((0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF))
FOUND = "longest:int,covered:int,tiles:int,coverage:double"
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    """Runs of letters and digits, lower case; composed forms where both exist."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).translate(UNSEEN)
    return WORD.findall(text.lower())


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


class Hasher:
    """64-bit hashes of words, kept while a task runs."""

    def __init__(self):
        self.known, self.nothing = _Hashes(), np.uint64(xxhash.xxh64_intdigest(""))

    def __call__(self, words: list[str]) -> np.ndarray:
        if len(self.known) > MOST_CACHED:
            self.known.clear()
        return np.fromiter(map(self.known.__getitem__, words), "uint64", len(words))


def rolling(ids: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of k ids, modulo 2^64."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, "uint64")
    mixed = ids.astype("uint64") * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(1)
    h = np.zeros(n, "uint64")
    for i in range(k):
        h = h * _BASE + mixed[i : i + n]
    return h


def tile(seeds: list[tuple[int, int]], doc: np.ndarray, item: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (document place, item place, length), longest matches first, none overlapping another.

    seeds are the places of equal runs of k words. Runs on one diagonal join into maximal matches; what an accepted
    tile leaves of another match goes back in if it still has k words.
    """
    matches: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    runs: dict[int, list[int]] = {}
    for d, i in sorted(seeds):
        if not np.array_equal(doc[d : d + k], item[i : i + k]):
            continue
        run = runs.get(d - i)
        if run and d <= run[0] + run[1] - k + 1:
            run[1] = d + k - run[0]
        else:
            if run:
                matches[run[1]].append((run[0], run[0] - (d - i), run[1]))
            runs[d - i] = [d, k]
    for diagonal, run in runs.items():
        matches[run[1]].append((run[0], run[0] - diagonal, run[1]))
    in_doc, in_item, tiles = set(), set(), []
    while matches:
        length = max(matches)
        for d, i, n in sorted(matches.pop(length)):
            free = [x for x in range(n) if d + x not in in_doc and i + x not in in_item]
            if len(free) == n:
                tiles.append((d, i, n))
                in_doc.update(range(d, d + n))
                in_item.update(range(i, i + n))
                continue
            start = None
            for x in [*free, None]:
                if start is not None and (x is None or x != last + 1):
                    if last - start + 1 >= k:
                        matches[last - start + 1].append((d + start, i + start, last - start + 1))
                    start = None
                if x is not None:
                    start, last = x if start is None else start, x
    return tiles


def shared_runs(doc: list[str], item: list[str], k: int) -> list[tuple[int, int]]:
    """(place in doc, place in item) of every equal run of k words."""
    at: dict[tuple[str, ...], list[int]] = defaultdict(list)
    for i in range(len(item) - k + 1):
        at[tuple(item[i : i + k])].append(i)
    return [(d, i) for d in range(len(doc) - k + 1) for i in at.get(tuple(doc[d : d + k]), ())]


def tiled(pieces: list[list[str]], item: list[str], k: int) -> tuple[int, int, int, float]:
    """(longest tile, words covered, tiles, part of the item covered) of an item's tiles in the stretches of a document."""
    words = [w for p in pieces for w in (*p, "")]
    number: dict[str, int] = {"": 0}
    ids = lambda ws: np.array([number.setdefault(w, len(number)) for w in ws], "int64")
    tiles = tile(shared_runs(words, item, k), ids(words), ids(item), k)
    covered = sum(n for _, _, n in tiles)
    return max((n for _, _, n in tiles), default=0), covered, len(tiles), covered / max(len(item), 1)


def _runs(rows: DataFrame, columns: str, k: int) -> DataFrame:
    """columns and h, the hash of each run of k words, of rows with words besides."""
    names = [c.split()[0] for c in columns.split(", ")]

    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        for frame in frames:
            found = [rolling(hasher(list(w)), k).view("int64") for w in frame["words"]]
            yield pd.DataFrame({**{c: frame[c].repeat([len(h) for h in found]) for c in names}, "h": np.concatenate(found) if found else np.zeros(0, "int64")})

    return rows.mapInPandas(hashed, f"{columns}, h bigint").distinct()


def _bitmap(runs: DataFrame) -> np.ndarray:
    """Bits, one of which is set for each hash; the driver gets at most MOST_BITS of them."""
    n, bits = runs.select("h").distinct().count(), LEAST_BITS
    while bits < min(n * BITS_A_RUN, MOST_BITS):
        bits *= 2
    slot = F.pmod("h", F.lit(bits))
    words = runs.select(F.shiftright(slot, 6).alias("w"), F.expr(f"shiftleft(1L, cast(pmod(h, {bits}) & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    out = np.zeros(bits // 64, "uint64")
    out[words["w"].to_numpy("int64")] = words["b"].to_numpy("int64").view("uint64")
    return out


def _stretches(documents: DataFrame, id_type: str, bitmap: np.ndarray, k: int) -> DataFrame:
    """uid, id, words: the stretches of each document's bodies whose runs of k words are in the bitmap. Documents stay where they are."""
    held = documents.sparkSession.sparkContext.broadcast(bitmap)

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits, hasher = held.value, Hasher()
        most = np.uint64(len(bits) * 64 - 1)

        def kept(rows: list[tuple[int, object, list[str]]]) -> pd.DataFrame:
            words = [w for *_, ws in rows for w in ws]
            owner = np.repeat(np.arange(len(rows)), [len(ws) for *_, ws in rows])
            ids = hasher(words)
            h, gaps = rolling(ids, k), np.concatenate([[0], np.cumsum(ids == hasher.nothing)])
            slot = h & most
            hit = (bits[(slot >> np.uint64(6)).astype("int64")] >> (slot & np.uint64(63))) & np.uint64(1)
            at = np.flatnonzero((hit == 1) & (gaps[k:] == gaps[: len(h)]))
            found = []
            if len(at):
                breaks = np.flatnonzero((np.diff(at) > k) | (owner[at[1:]] != owner[at[:-1]])) + 1
                for run in np.split(at, breaks):
                    uid, doc_id, _ = rows[owner[run[0]]]
                    piece = words[run[0] : run[-1] + k]
                    found.append((uid, doc_id, piece))
            return pd.DataFrame(found, columns=["uid", "id", "words"])

        for frame in frames:
            rows, size = [], 0
            for uid, doc_id, text in zip(frame["uid"], frame["id"], frame["text"], strict=True):
                rows.append((uid, doc_id, [w for body in text_bodies(text) for w in (*words_of(body), "")]))
                size += len(text)
                if size > CHUNK_CHARS:
                    yield kept(rows)
                    rows, size = [], 0
            if rows:
                yield kept(rows)

    return documents.mapInPandas(scan, f"uid bigint, id {id_type}, words array<string>")


def leaked_items(documents: DataFrame, items: DataFrame, min_tile: int = 6, min_run: int = 12, min_coverage: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, item_id, longest, covered, tiles, coverage: the items whose text occurs in a document's text bodies.

    Tiles are runs of at least min_tile equal words, none overlapping another, longest first; covered is the number of
    the item's words in tiles. A pair is reported if its longest tile has min_run words or, with min_coverage, if
    that part of the item is covered, in whatever order. Null texts and items with less than min_tile words match
    nothing; an item_id that occurs twice stands for each of its texts; a repeated document comes out each time.

    Documents are read once, whatever the number of items. Stretches of them that may be an item's, and the items, are
    joined by hashes of runs of min_tile words; only documents and items that share one are compared word by word.
    """
    k, id_type = min_tile, documents.schema[id_col].dataType.simpleString()

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(words_of)

    @F.pandas_udf(f"struct<{FOUND}>")
    def lay(pieces: pd.Series, words: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([tiled([list(p) for p in ps], list(w), k) for ps, w in zip(pieces, words, strict=True)], columns=[c.split(":")[0] for c in FOUND.split(",")])

    known = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", cut("text").alias("words")).distinct()
    known = write_table(known.where(F.size("words") >= k).withColumn("item", F.monotonically_increasing_id()), "items")
    runs = write_table(_runs(known, "item bigint", k), "item-runs")
    texts = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    texts = spread(texts).withColumn("uid", F.monotonically_increasing_id())
    held = write_table(_stretches(texts, id_type, _bitmap(runs), k), "stretches")
    pairs = _runs(held, "uid bigint", k).join(runs, "h").select("uid", "item").distinct()
    pieces = held.groupBy("uid").agg(F.first("id").alias("id"), F.collect_list("words").alias("pieces"))
    found = pairs.join(pieces, "uid").join(known, "item").withColumn("t", lay("pieces", "words")).select("id", "item_id", "t.*")
    enough = F.col("longest") >= min_run
    if min_coverage is not None:
        enough = enough | (F.col("coverage") >= min_coverage)
    return found.where(enough).withColumnRenamed("id", id_col)
