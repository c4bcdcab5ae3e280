"""Benchmark decontamination: suffix arrays over shards of documents, searched by every benchmark suffix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import offsets, small_batches, table, utf8

WINDOW = 10
#: Words of benchmark text that one pass over the documents looks for; a larger benchmark takes more passes.
BLOCK_WORDS = 2_000_000

#: Lower-cases A-Z and blanks every other ASCII character but 0-9 and a-z; bytes above 0x7F belong to words.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def words(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class Windows:
    """The distinct windows of a block of items, by window length, each with the places it has in items."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.names = [name for name, _ in items]
        self.vocabulary: dict[bytes, int] = {}
        places: dict[int, dict[tuple, list[tuple[int, int]]]] = {}
        for item, (_, own) in enumerate(items):
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in own]
            size = min(window, len(ids))
            for at in range(len(ids) - size + 1 if ids else 0):
                places.setdefault(size, {}).setdefault(tuple(ids[at : at + size]), []).append((item, at))
        self.by_size = {size: (np.array(list(found), np.int64), list(found.values())) for size, found in places.items()}


def suffix_array(values: np.ndarray, depth: int) -> np.ndarray:
    """Positions ordered by their first ``depth`` or more values (prefix doubling; ranks follow the values' order)."""
    rank = np.unique(values, return_inverse=True)[1].astype(np.int64)
    step = 1
    while step < depth:
        after = np.zeros(len(rank), np.int64)
        after[:-step or None] = rank[step:] + 1
        rank = np.unique(rank * (len(rank) + 2) + after, return_inverse=True)[1].astype(np.int64)
        step *= 2
    return np.argsort(rank, kind="stable")


def bound(padded: np.ndarray, order: np.ndarray, wanted: np.ndarray, upper: bool) -> np.ndarray:
    """Binary search of every wanted row among the sorted suffixes, by the first ``wanted.shape[1]`` values."""
    low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(order), np.int64)
    reach = np.arange(wanted.shape[1])
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        middle = (low[open_] + high[open_]) // 2
        differ = padded[order[middle][:, None] + reach] - wanted[open_]
        first = differ[np.arange(len(open_)), (differ != 0).argmax(axis=1)]
        right = first <= 0 if upper else first < 0
        low[open_[right]] = middle[right] + 1
        high[open_[~right]] = middle[~right]


def search(texts: list[bytes], windows: Windows) -> list[tuple[int, list, list, list]]:
    """Per text: words, hit spans, names of items with windows in it, and maximal matches (item, at, word, length)."""
    get = windows.vocabulary.get
    each = [np.fromiter((get(w, -1) for w in words(t)), np.int64) for t in texts]
    counts = np.array([len(x) for x in each], np.int64)
    starts = offsets(counts + 1)  # a separator ends each document
    joined = np.full(starts[-1], -1, np.int64)
    for at, ids in zip(starts, each):
        joined[at : at + len(ids)] = ids
    hits: list[tuple[int, int, int, int]] = []
    if windows.by_size and len(joined):
        least = min(windows.by_size)
        # only runs of at least the shortest window's length that consist of benchmark words can match
        edge = np.flatnonzero(np.diff(np.r_[0, (joined >= 0).view(np.int8), 0]))
        runs = edge.reshape(-1, 2)
        runs = runs[runs[:, 1] - runs[:, 0] >= least]
        lengths = runs[:, 1] - runs[:, 0] + 1
        if len(runs):
            at = np.repeat(runs[:, 0] - offsets(lengths)[:-1], lengths) + np.arange(lengths.sum())
            part = joined[at]
            depth = max(windows.by_size)
            padded = np.r_[part, np.full(depth, -1)]
            order = suffix_array(part, depth)
            for size, (wanted, places) in windows.by_size.items():
                low, high = bound(padded, order, wanted, False), bound(padded, order, wanted, True)
                for k in np.flatnonzero(low < high):
                    for p in at[order[low[k] : high[k]]]:
                        hits += [(int(p), size, item, where) for item, where in places[k]]
    by_doc: dict[int, list] = {}
    if hits:
        owner = np.searchsorted(starts, [h[0] for h in hits], "right") - 1
        for d, (p, size, item, where) in zip(owner.tolist(), hits):
            by_doc.setdefault(d, []).append((p - int(starts[d]), size, item, where))
    return [(int(n), *spans_and_matches(by_doc.get(d, []), windows.names)) for d, n in enumerate(counts)]


def spans_and_matches(hits: list[tuple[int, int, int, int]], names: list[str]) -> tuple[list, list, list]:
    spans: list[list[int]] = []
    for p, size, _, _ in sorted(hits):
        if spans and p <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], p + size)
        else:
            spans.append([p, p + size])
    matches: list[list] = []
    last = None
    for item, shift, p, size in sorted((item, p - where, p, size) for p, size, item, where in hits):
        if last == (item, shift, p - 1):
            matches[-1][3] = p + size - matches[-1][2]
        else:
            matches.append([names[item], p - shift, p, size])
        last = (item, shift, p)
    return spans, sorted({names[item] for _, _, item, _ in hits}), matches


FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField(
            "matches",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("item_id", T.StringType()),
                        T.StructField("item_word", T.LongType()),
                        T.StructField("doc_word", T.LongType()),
                        T.StructField("length", T.LongType()),
                    ]
                )
            ),
        ),
    ]
)


def finder(windows: Broadcast):
    @F.pandas_udf(FOUND)
    def find(texts: pd.Series) -> pd.DataFrame:
        names = FOUND["matches"].dataType.elementType.names
        rows = [(n, spans, items, [dict(zip(names, m)) for m in matches]) for n, spans, items, matches in search(list(texts), windows.value)]
        return pd.DataFrame(rows, columns=FOUND.names)

    return find


def blocks(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items in blocks of about ``limit`` words, streamed through the driver one block at a time."""
    held, size = [], 0
    for row in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), utf8().alias("t")).toLocalIterator():
        held.append((row.i, words(bytes(row.t))))
        size += len(held[-1][1])
        if size >= limit:
            yield held
            held, size = [], 0
    if held or not size:
        yield held


def union(parts: list[Column]) -> Column:
    """The number of words under spans of any block."""

    @F.pandas_udf(T.LongType())
    def covered(spans: pd.Series) -> pd.Series:
        def length(row) -> int:
            end = total = 0
            for a, b in sorted(map(tuple, row)):
                total += max(0, b - max(a, end))
                end = max(end, b)
            return total

        return spans.map(length)

    return covered(F.flatten(F.array(*parts)))


def searched(docs: DataFrame, benchmark: DataFrame, column: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with ``__n_words``, ``__n_hit``, ``__items`` (sorted names) and ``__matches``.

    A batch of documents is a shard: its suffix array is built once and every benchmark suffix is searched in
    it; ranges of the array give all places of a window, and runs of windows the maximal matches. NULL or empty texts
    have no words; an empty benchmark finds nothing; repeated items are found each under its own name (NULL: "").
    """
    small_batches(docs.sparkSession, rows=1024, mb=4)
    out, found = docs, []
    for number, items in enumerate(blocks(benchmark, block_words)):
        windows = docs.sparkSession.sparkContext.broadcast(Windows(items))

        found.append(f"__f{number}")
        out = out.withColumn(found[-1], finder(windows)(utf8(column)))
    out = out.withColumn("__n_words", F.col(f"{found[0]}.n_words"))
    out = out.withColumn("__n_hit", union([F.col(f"{f}.spans") for f in found]))
    out = out.withColumn("__items", F.array_sort(F.array_distinct(F.flatten(F.array(*[F.col(f"{f}.items") for f in found])))))
    return out.withColumn("__matches", F.flatten(F.array(*[F.col(f"{f}.matches") for f in found]))).drop(*found)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no window of the benchmark occurs, with their own columns."""
    return searched(docs, benchmark).where("__n_hit = 0").select(docs.columns)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = searched(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id",
        F.col("__n_words").alias("n_words"),
        F.col("__n_hit").alias("n_hit"),
        F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.array_join("__items", ","), 256).alias("items_sha256"),
        (F.col("__n_hit") > 0).alias("contaminated"),
    )
