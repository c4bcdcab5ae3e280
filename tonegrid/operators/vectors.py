"""Word-vector operators: sentence sums, nearest words, feature expansion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import bounded_batches, materialize, released, scratch_path, union_all
from .skew import small_side, within

# Query vectors of a row (400-wide doubles: 0.8 MB), and vocabulary words that meet them in one task (52 MB).
QUERY_BLOCK = 256
PART_WORDS = 1 << 14
# A vector table of at most this many numbers is broadcast (64 MB of doubles).
BROADCAST_CELLS = 8_000_000
# Documents, and MB of them, that ask for vectors together; documents of an output batch, and tokens gathered at once.
BLOCK_ROWS, BLOCK_MB = 20_000, 8
SUMMED_ROWS, SUMMED_TOKENS = 1024, 1 << 14


def sum_vectors(rows: DataFrame, keys: list[str], dim: int, vec: str = "vec") -> DataFrame:
    """Element-wise sums per key; NULL vectors count as zeros. One sum per dimension, no row blow-up."""
    sums = [F.sum(F.get(vec, F.lit(i)).cast("double")).alias(f"s{i}") for i in range(dim)]
    out = rows.groupBy(*keys).agg(*sums)
    return out.select(*keys, F.array(*[F.coalesce(f"s{i}", F.lit(0.0)) for i in range(dim)]).alias("vec"))


def sentence_vectors(docs: DataFrame, vectors: DataFrame, dim: int, max_words: int | None = None) -> DataFrame:
    """Sum of the vectors of a document's words: the columns of ``docs``, ``vec`` in place of ``tokens``.

    Words without a vector are skipped; a document with none gets zeros. A vector table of known
    (``max_words``) or counted small size is broadcast. Beyond that, blocks of documents ask for the
    vectors of their distinct words.
    """
    keys = [c for c in docs.columns if c != "tokens"]
    table = vectors.select(F.col("word").alias("token"), "vec")
    small = max_words * dim <= BROADCAST_CELLS if max_words is not None else within(vectors, BROADCAST_CELLS // dim)
    if small:
        rows = docs.select(*keys, F.explode_outer("tokens").alias("token"))
        return sum_vectors(rows.join(F.broadcast(table), "token", "left"), keys, dim)
    return sum_vectors(summed_in_blocks(docs, keys, table, dim), keys, dim)


def _word_blocks(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """A batch of documents as one row: their keys, where each begins, the places of its words, and the block's own words."""
    block = TaskContext.get().partitionId() << 32
    for batch in batches:
        tokens = batch.column("tokens")
        sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
        flat = pc.dictionary_encode(tokens.flatten())
        cells = pc.fill_null(flat.indices, -1).to_numpy(zero_copy_only=False).astype(np.int32)
        starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        own = pa.StructArray.from_arrays([batch.column(k) for k in keys], names=keys)
        whole = lambda values: pa.ListArray.from_arrays([0, len(values)], values)
        columns = {"block": pa.array([block]), "keys": whole(own), "starts": pa.array([starts.tobytes()]),
                   "cells": pa.array([cells.tobytes()]), "words": whole(flat.dictionary.cast(pa.string()))}
        yield pa.RecordBatch.from_pydict(columns)
        block += 1
    released()


def _block_sums(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (block, kind): the vectors of a block's words by place, then its body; the sum of each document."""
    block, places, held = None, [], []
    for batch in batches:
        kinds, numbers = batch.column("kind").to_pylist(), batch.column("block").to_pylist()
        for i, (number, kind) in enumerate(zip(numbers, kinds)):
            if number != block:
                block, places, held = number, [], []
            if kind == 0:
                places.append(batch.column("place")[i].as_py())
                held.append(np.asarray(batch.column("vec")[i].values.to_numpy(zero_copy_only=False), np.float64))
                continue
            starts, cells = (np.frombuffer(batch.column(c)[i].as_py(), t) for c, t in (("starts", np.int64), ("cells", np.int32)))
            table = np.zeros((len(places) + 1, dim))
            at = np.full(max(cells.max(initial=0), max(places, default=0)) + 2, len(places))
            # a word that the vector table has several times counts as often
            order, first = np.unique(places, return_inverse=True) if places else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            for k, vec in zip(first, held):
                table[k] += vec
            at[order.astype(np.int64)] = np.arange(len(order))
            rows, keys = at[cells], batch.column("keys")[i].values
            for low in range(0, len(keys), SUMMED_ROWS):
                spans = list(zip(starts[low : low + SUMMED_ROWS], starts[low + 1 : low + 1 + SUMMED_ROWS]))
                sums = np.zeros((len(spans), dim))
                for k, (begin, end) in enumerate(spans):
                    for piece in range(begin, end, SUMMED_TOKENS):
                        sums[k] += table[rows[piece : min(end, piece + SUMMED_TOKENS)]].sum(axis=0)
                ends = np.arange(len(spans) + 1, dtype=np.int32) * dim
                part = keys.slice(low, len(spans))
                columns = [part.field(k) for k in range(part.type.num_fields)]
                names = [part.type.field(k).name for k in range(part.type.num_fields)]
                yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(ends, sums.ravel())], names=[*names, "vec"])
    released()


def summed_in_blocks(docs: DataFrame, keys: list[str], table: DataFrame, dim: int) -> DataFrame:
    """``(keys…, vec)`` of every row of ``docs``. A batch of documents asks once for the vector of each of its own words.

    What is shuffled is one vector per block and distinct word, not one per token; a frequent word has one row per block.
    """
    spark = docs.sparkSession
    bounded_batches(spark, rows=BLOCK_ROWS, mb=BLOCK_MB)
    part = docs.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], "tokens")
    names = [f"k{i}" for i in range(len(keys))]
    fields = ", ".join(f"{n}: {part.schema[n].dataType.simpleString()}" for n in names)
    schema = f"block long, keys array<struct<{fields}>>, starts binary, cells binary, words array<string>"
    path = scratch_path(spark, "word_blocks")
    part.mapInArrow(lambda batches: _word_blocks(batches, names), schema).write.parquet(path)
    blocks = spark.read.parquet(path)
    listed = blocks.select("block", F.posexplode("words").alias("place", "token"))
    # NULL components and missing ones count as zeros
    full = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.get("vec", i), F.lit(0).cast(table.schema["vec"].dataType.elementType)))
    # the size estimate of exploded words is far too low to choose a broadcast side by
    pulled = listed.join(table.where("vec IS NOT NULL").select("token", full.alias("vec")).hint("merge"), "token")
    pulled = pulled.select("block", F.lit(0).alias("kind"), "place", "vec")
    bodies = blocks.select("block", F.lit(1).alias("kind"), "keys", "starts", "cells")
    rows = union_all(pulled.withColumns({c: F.lit(None).cast(bodies.schema[c].dataType) for c in ("keys", "starts", "cells")}),
                     bodies.withColumns({c: F.lit(None).cast(pulled.schema[c].dataType) for c in ("place", "vec")}))
    dealt = rows.repartition("block").sortWithinPartitions("block", "kind")
    out = f"{', '.join(f'{n} {part.schema[n].dataType.simpleString()}' for n in names)}, vec array<double>"
    found = dealt.mapInArrow(lambda batches: _block_sums(batches, dim), out)
    return found.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], "vec")


# Numbers of a vector that are drawn at once for the words of a block.
DRAWN = 32


def _drawn_sums(batches: Iterator[pa.RecordBatch], dim: int, draw) -> Iterator[pa.RecordBatch]:
    """Blocks with the places and codes of their known words; the sum of each document's vectors, drawn here from the codes."""
    for batch in batches:
        for i in range(len(batch)):
            starts, cells = (np.frombuffer(batch.column(c)[i].as_py(), t) for c, t in (("starts", np.int64), ("cells", np.int32)))
            places, codes = (pc.fill_null(batch.column(c)[i].values, 0).to_numpy(zero_copy_only=False) if batch.column(c)[i].is_valid else np.zeros(0, np.int64) for c in ("places", "codes"))
            # a word that the table has several times counts as often
            order, first, times = np.unique(places, return_index=True, return_counts=True)
            at = np.full(max(cells.max(initial=0), order.max(initial=0)) + 2, len(order))
            at[order] = np.arange(len(order))
            rows, sums = at[cells], np.zeros((len(starts) - 1, dim))
            for low in range(0, dim, DRAWN):
                high = min(low + DRAWN, dim)
                table = np.zeros((len(order) + 1, high - low))
                for a in range(0, len(order), SUMMED_ROWS):
                    b = min(a + SUMMED_ROWS, len(order))
                    table[a:b] = draw(codes[first[a:b]], low, high) * times[a:b, None]
                for k, (begin, end) in enumerate(zip(starts.tolist(), starts[1:].tolist())):
                    for piece in range(begin, end, SUMMED_TOKENS):
                        sums[k, low:high] += table[rows[piece : min(end, piece + SUMMED_TOKENS)]].sum(axis=0)
            keys = batch.column("keys")[i].values
            for low in range(0, len(keys), SUMMED_ROWS):
                part, held = keys.slice(low, SUMMED_ROWS), sums[low : low + SUMMED_ROWS]
                ends = np.arange(len(held) + 1, dtype=np.int32) * dim
                columns = [part.field(k) for k in range(part.type.num_fields)]
                names = [part.type.field(k).name for k in range(part.type.num_fields)]
                yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(ends, held.ravel())], names=[*names, "vec"])
    released()


def drawn_sums(docs: DataFrame, words: DataFrame, dim: int, draw) -> DataFrame:
    """``sentence_vectors`` where a word's vector follows from its code: the columns of ``docs``, ``vec`` in place of ``tokens``.

    ``words`` is ``(word, code)``; ``draw(codes, low, high)`` gives the numbers ``low`` to ``high`` of their vectors. Blocks ask
    for the codes of their distinct words, so no vector is stored or shuffled but one per document.
    """
    spark = docs.sparkSession
    bounded_batches(spark, rows=BLOCK_ROWS, mb=BLOCK_MB)
    keys = [c for c in docs.columns if c != "tokens"]
    names = [f"k{i}" for i in range(len(keys))]
    part = docs.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], "tokens")
    fields = ", ".join(f"{n}: {part.schema[n].dataType.simpleString()}" for n in names)
    schema = f"block long, keys array<struct<{fields}>>, starts binary, cells binary, words array<string>"
    path = scratch_path(spark, "word_blocks")
    part.mapInArrow(lambda batches: _word_blocks(batches, names), schema).write.parquet(path)
    blocks = spark.read.parquet(path)
    listed = blocks.select("block", F.posexplode("words").alias("place", "token"))
    # the size estimate of exploded words is far too low to choose a broadcast side by
    known = listed.join(words.select(F.col("word").alias("token"), "code").hint("merge"), "token")
    known = known.groupBy("block").agg(F.collect_list(F.struct("place", "code")).alias("k"))
    known = known.select("block", F.col("k.place").alias("places"), F.col("k.code").alias("codes"))
    asked = blocks.select("block", "keys", "starts", "cells").join(known.hint("merge"), "block", "left")
    out = f"{', '.join(f'{n} {part.schema[n].dataType.simpleString()}' for n in names)}, vec array<double>"
    found = asked.mapInArrow(lambda batches: _drawn_sums(batches, dim, draw), out)
    # rows that no column tells apart are added up, as in sum_vectors; nearly always there is one
    grouped = found.groupBy(*names).agg(F.collect_list("vec").alias("vecs"))
    added = F.aggregate(F.slice("vecs", 2, F.greatest(F.size("vecs"), F.lit(1))), F.col("vecs")[0], lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    vec = F.when(F.size("vecs") == 1, F.col("vecs")[0]).otherwise(added)
    return grouped.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], vec.alias("vec"))


def _first(n: int, q: np.ndarray, s: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best ``n`` of each query ``q`` by score ``s``, ties by word ``w``."""
    order = np.lexsort((w, -s, q))
    q = q[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < n
    return q[keep], s[order][keep], w[order][keep]


def _blocked(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """Unit query vectors as blocks of one row; zero and NULL vectors ask for nothing."""
    for batch in batches:
        batch = batch[batch["vec"].notna()]
        for at in range(0, len(batch), size):
            rows = batch.iloc[at : at + size]
            matrix = np.stack([np.asarray(v, np.float64) for v in rows["vec"]])
            norms = np.linalg.norm(matrix, axis=1)
            rows, unit = rows[norms > 0], matrix[norms > 0] / norms[norms > 0][:, None]
            if len(rows):
                one = (rows["word"].tolist(), [list(x) for x in rows["excluded"]], unit.tobytes())
                yield pd.DataFrame([one], columns=["queries", "excluded", "unit"])


def _met(codes: np.ndarray, asked: np.ndarray) -> Iterator[np.ndarray]:
    """For each query the words that share the number of at least one band with it; ``codes`` has a column per band."""
    order = np.argsort(codes, axis=0, kind="stable")
    spans = []
    for band in range(codes.shape[1]):
        sorted_codes = codes[order[:, band], band]
        spans.append((np.searchsorted(sorted_codes, asked[:, band]), np.searchsorted(sorted_codes, asked[:, band], "right")))
    for q in range(len(asked)):
        mask = np.zeros(len(codes), bool)
        for band, (low, high) in enumerate(spans):
            mask[order[low[q] : high[q], band]] = True
        yield mask


def _part_top(batches: Iterator[pd.DataFrame], n: int, digits: int, coded=None) -> Iterator[pd.DataFrame]:
    """Rows sorted by (part, kind): the words of a part, then the blocks of queries that meet it; the best ``n`` of each.

    With ``coded``, a function from unit vectors to a number per band, a query is compared only with words that share one.
    """
    part, held, words, table, codes = None, [], None, None, None
    for batch in batches:
        out = []
        for number, kind, word, vec, queries, excluded, unit in batch[_COLUMNS].itertuples(index=False):
            if number != part:
                part, held, table, codes = number, [], None, None
            if kind == 0:
                held.append((word, np.asarray(vec, np.float64)))
                continue
            if not held:
                continue
            if table is None:
                words = np.array([w for w, _ in held], dtype=str)
                table = np.stack([v for _, v in held])
                norms = np.linalg.norm(table, axis=1)
                table = table / np.where(norms == 0.0, np.nan, norms)[:, None]
                own: dict[str, list[int]] = {}
                for i, w in enumerate(words.tolist()):
                    own.setdefault(w, []).append(i)
            unit = np.frombuffer(unit, np.float64).reshape(len(queries), -1)
            if coded is None:
                sims = np.round(table @ unit.T, digits)
            else:
                sims = np.full((len(words), len(queries)), -np.inf)
                codes = coded(table) if codes is None else codes
                for q, mask in enumerate(_met(codes, coded(unit))):
                    sims[mask, q] = np.round(table[mask] @ unit[q], digits)
            sims[np.isnan(sims)] = -np.inf
            for q, names in enumerate(excluded):
                for name in names:
                    sims[own.get(name, []), q] = -np.inf
            cut = np.partition(sims, len(words) - n, axis=0)[len(words) - n] if len(words) > n else -np.inf
            i, q = np.nonzero((sims >= cut) & (sims > -np.inf))
            q, s, w = _first(n, q, sims[i, q], words[i])
            out.append(pd.DataFrame({"query": [queries[k] for k in q], "word": w.tolist(), "cosine": s}))
        if out:
            yield pd.concat(out)


_COLUMNS = ["part", "kind", "word", "vec", "queries", "excluded", "unit"]


def nearest_words(queries: DataFrame, vectors: DataFrame, n: int = 10, digits: int = 6) -> DataFrame:
    """The ``n`` most similar words of each query: ``(query, word, cosine, rank)``, ties by word.

    ``queries`` is ``(word, vec)``, e.g. a selected feature set, and may name in ``excluded`` the words it must not find;
    otherwise that is the query itself. Queries become rows of ``QUERY_BLOCK``; the vocabulary is dealt into parts of about
    ``PART_WORDS`` words, and every block meets every part there, whose task returns its best ``n`` per query. So nothing
    passes through the driver, and nothing of the size of the product is stored or shuffled.
    """
    return _searched(queries, vectors, n, digits, None)


def _searched(queries: DataFrame, vectors: DataFrame, n: int, digits: int, coded) -> DataFrame:
    excluded = F.col("excluded") if "excluded" in queries.columns else F.array("word")
    asked = queries.select("word", F.col("vec").cast("array<double>").alias("vec"), excluded.alias("excluded"))
    size = QUERY_BLOCK
    blocks = asked.mapInPandas(lambda batches: _blocked(batches, size), "queries array<string>, excluded array<array<string>>, unit binary")
    table = vectors.where("vec IS NOT NULL").select("word", F.col("vec").cast("array<double>").alias("vec"))
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    parts = max(cores, -(-table.count() // PART_WORDS))
    left = table.select(F.pmod(F.xxhash64("word"), F.lit(parts)).alias("part"), F.lit(0).alias("kind"), "word", "vec")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))
    right = materialize(blocks).select(every.alias("part"), F.lit(1).alias("kind"), "queries", "excluded", "unit")
    rows = left.unionByName(right, allowMissingColumns=True).repartition(parts, "part").sortWithinPartitions("part", "kind")
    found = rows.mapInPandas(lambda batches: _part_top(batches, n, digits, coded), "query string, word string, cosine double")
    best = W.partitionBy("query").orderBy(F.desc("cosine"), "word")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)


def _signs(bits: int, bands: int, dim: int, seed: int):
    """A function from vectors to the signs of ``bits`` random projections per band, as one number; directions are fixed by ``seed``."""
    planes = np.random.default_rng(seed).standard_normal((bands * bits, dim))
    powers = 1 << np.arange(bits)

    def codes(unit: np.ndarray) -> np.ndarray:
        return (unit @ planes.T > 0).reshape(len(unit), bands, bits) @ powers

    return codes


def nearest_words_lsh(
    queries: DataFrame, vectors: DataFrame, dim: int, n: int = 10, bits: int = 4, bands: int = 32, seed: int = 0, digits: int = 6
) -> DataFrame:
    """As ``nearest_words``, but a query meets only words that share the signs of a band with it: ``(query, word, cosine, rank)``.

    Sign projections find words at angle a with odds 1 - (1 - (1 - a / pi)^bits)^bands. More bits make buckets
    smaller, more bands raise recall; ``recall`` measures it. Blocks of queries meet parts of the vocabulary as there; inside a
    task, words are sorted by the number of each band, so pairs are neither listed nor shuffled.
    """
    return _searched(queries, vectors, n, digits, _signs(bits, bands, dim, seed))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """``(n_queries, n_exact, n_found, recall)``: which of the exact neighbours were found."""
    hits = exact.select("query", "word").join(found.select("query", "word", F.lit(1).alias("hit")), ["query", "word"], "left")
    counts = hits.agg(F.count_distinct("query").alias("n_queries"), F.count("*").alias("n_exact"), F.count("hit").alias("n_found"))
    return counts.withColumn("recall", F.col("n_found") / F.col("n_exact"))


def pair_queries(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """``(word, vec, excluded)`` of two-word features: the mean of the two unit vectors, both words excluded.

    ``pairs`` has ``feature``; a pair of which a word has no vector, or none of any length, asks for nothing.
    """
    square = F.aggregate(F.col("vec"), F.lit(0.0), lambda s, x: s + x * x)
    unit = vectors.select("word", F.col("vec").cast("array<double>").alias("vec")).withColumn("norm", F.sqrt(square)).where("norm > 0")
    unit = unit.select("word", F.transform("vec", lambda x: x / F.col("norm")).alias("unit"))
    sides = [unit.select(F.col("word").alias(f"w{i}"), F.col("unit").alias(f"u{i}")) for i in (1, 2)]
    two = pairs.select(F.col("feature")[0].alias("w1"), F.col("feature")[1].alias("w2"))
    both = sides[0].join(small_side(two), "w1")
    both = sides[1].join(small_side(both), "w2")
    mean = F.zip_with("u1", "u2", lambda a, b: (a + b) / 2)
    return both.select(F.concat_ws(" ", "w1", "w2").alias("word"), mean.alias("vec"), F.array("w1", "w2").alias("excluded"))


def expand_features(features: DataFrame, vectors: DataFrame, n: int = 10, pairs: bool = False) -> DataFrame:
    """Selected features plus the nearest words of each: ``(feature, rank, source)``.

    Words without a vector bring in nothing; neither do pairs, unless ``pairs`` asks for the words nearest to the mean of their
    two vectors. A neighbour carries the best rank of the features that brought it in, so ``rank <= k`` gives the
    expansion of the first k features. ``features`` is read many times, so it is computed and stored first.
    """
    features = materialize(features.select("feature", "rank"))
    single = features.where(F.size("feature") == 1).select(F.col("feature")[0].alias("word"), "rank")
    queries = vectors.join(small_side(single), "word").select("word", "vec")
    if pairs:
        two = features.where(F.size("feature") == 2)
        single = union_all(single, two.select(F.array_join("feature", " ").alias("word"), "rank"))
        one = queries.select("word", F.col("vec").cast("array<double>").alias("vec"), F.array("word").alias("excluded"))
        queries = union_all(one, pair_queries(two, vectors))
    near = nearest_words(queries, vectors, n).select(F.col("query").alias("by"), "word")
    near = near.join(single.withColumnRenamed("word", "by"), "by")
    added = near.select(F.array("word").alias("feature"), "rank", F.lit("expanded").alias("source"))
    both = union_all(features.select("feature", "rank", F.lit("selected").alias("source")), added)
    first = F.min(F.struct((F.col("source") != "selected").alias("late"), "rank", "source")).alias("m")
    return both.groupBy("feature").agg(F.min("rank").alias("rank"), first).select("feature", "rank", "m.source")
