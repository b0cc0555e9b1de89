"""Problem 8: texts packed whole into containers of a fixed number of tokens."""

from __future__ import annotations

import base64
import heapq
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.plans.shared import spread, write_table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how this public vocabulary cuts a text before merging.
CUT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Rows that one group of the ranking should hold, about.
GROUP_ROWS = 100_000
_ENCODERS: dict[str, object] = {}


def _encoder(path: str):
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("packing", pat_str=CUT, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def token_count(text: Column, path: str = VOCABULARY) -> Column:
    """Tokens of a text in the vocabulary at path, a file that every executor must have; null for null."""

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        enc = _encoder(path)
        return pd.Series([None if t is None else len(enc.encode_ordinary(t)) for t in texts], dtype="Int32")

    return count(text)


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Shortest-pack-first: (containers, {length: items in each}) for a number of items of each length.

    Lengths are placed longest first. An item goes into the pack that is shortest so far, and only if it fits into
    none into a new one. All packs of one pattern are moved at once, so the work depends on the number of lengths and
    not of items.
    """
    patterns: dict[tuple[tuple[int, int], ...], int] = defaultdict(int)
    heap: list[tuple[int, tuple[tuple[int, int], ...]]] = []  # by filling, shortest first

    def add(pattern: tuple[tuple[int, int], ...], filled: int, n: int) -> None:
        if pattern not in patterns:
            heapq.heappush(heap, (filled, pattern))
        patterns[pattern] += n

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if heap and heap[0][0] + length <= capacity:
                filled, pattern = heap[0]
                n = min(left, patterns[pattern])
                patterns[pattern] -= n
                if not patterns[pattern]:
                    heapq.heappop(heap)
                    del patterns[pattern]
            else:
                filled, pattern = 0, ()
                n = -(-left // (capacity // length))
            last = pattern[-1] if pattern else (0, 0)
            grown = (*pattern[:-1], (length, last[1] + 1)) if last[0] == length else (*pattern, (length, 1))
            add(grown, filled + length, n)
            left -= n
    return [(n, dict(p)) for p, n in patterns.items()]


def _places(packed: list[tuple[int, dict[int, int]]]) -> dict[str, np.ndarray]:
    """For each length, intervals of ranks: where an interval starts, its first container and items a container."""
    nexts: dict[int, int] = defaultdict(int)
    rows, base = [], 0
    for n, pattern in packed:
        for length, k in pattern.items():
            rows.append((length, nexts[length], base, k))
            nexts[length] += n * k
        base += n
    rows.sort()
    cols = np.array(rows, dtype="int64").reshape(-1, 4)
    return {"key": cols[:, 0] * _WIDE + cols[:, 1], "start": cols[:, 1], "base": cols[:, 2], "k": cols[:, 3]}


_WIDE = 1 << 46


def pack_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, vocabulary: str = VOCABULARY) -> DataFrame:
    """id, piece, start_token, end_token, container: where each text, or each piece of a longer one, goes.

    Texts of up to capacity tokens stay whole; longer ones are cut every capacity tokens. Texts without tokens take no
    space and go into container 0; null texts are left out. Repeated ids are packed as often as they occur.
    Containers are numbered from 0. An empty table gives an empty result.

    Each text is tokenised once. Only the histogram of lengths, at most capacity numbers, comes to the driver, and
    only the packing patterns, whose number depends on the capacity, go back. Ranks within a length are counted in
    groups of bounded size, each with the number of items before it.
    """
    texts = spread(documents.select(F.col(id_col).alias("_id"), text_col).where(F.col(text_col).isNotNull()))
    sized = texts.select("_id", token_count(F.col(text_col), vocabulary).alias("n"))
    sized = write_table(sized, "token-counts")
    full = F.lit(capacity)
    pieces = sized.select("_id", "n", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("n") - 1) / full).cast("int")))).alias("piece"))
    pieces = pieces.select("_id", "piece", (F.col("piece") * full).alias("start_token"), F.least(F.col("n"), (F.col("piece") + 1) * full).alias("end_token"))
    pieces = pieces.withColumn("length", F.col("end_token") - F.col("start_token"))
    total = sized.count()
    groups = max(8, total // GROUP_ROWS)
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64("_id", "piece"), F.lit(groups)).cast("int"))
    counts = write_table(pieces.where("length > 0").groupBy("length", "part").agg(F.count(F.lit(1)).alias("m")), "length-counts")
    histogram = {r["length"]: r["s"] for r in counts.groupBy("length").agg(F.sum("m").alias("s")).collect()}
    places = documents.sparkSession.sparkContext.broadcast(_places(pack_histogram(histogram, capacity)))
    before = counts.select("length", "part", (F.sum("m").over(Window.partitionBy("length").orderBy("part")) - F.col("m")).alias("before"))
    ranked = pieces.withColumn("at", F.row_number().over(Window.partitionBy("length", "part").orderBy("_id", "piece")) - 1)
    ranked = ranked.join(before, ["length", "part"], "left")

    @F.pandas_udf("bigint")
    def container(length: pd.Series, rank: pd.Series) -> pd.Series:
        p, n, r = places.value, length.to_numpy("int64"), rank.fillna(0).to_numpy("int64")
        if not len(p["key"]):
            return pd.Series(np.zeros(len(n), "int64"))
        i = np.maximum(np.searchsorted(p["key"], n * _WIDE + r, "right") - 1, 0)
        return pd.Series(np.where(n > 0, p["base"][i] + (r - p["start"][i]) // p["k"][i], 0))

    at = container(F.col("length"), F.col("before") + F.col("at"))
    return ranked.select(F.col("_id").alias(id_col), "piece", "start_token", "end_token", at.alias("container"))


def container_fill(packed: DataFrame) -> DataFrame:
    """container, its items and its tokens."""
    return packed.groupBy("container").agg(F.count(F.lit(1)).alias("items"), F.sum(F.col("end_token") - F.col("start_token")).cast("bigint").alias("tokens"))
