"""Nearest vectors by cosine: randomly rotated one-bit codes choose, with error bounds, what is compared exactly.

A unit vector is rotated into ``BITS`` dimensions; its code is the signs there, its correction scalar the inner product of
itself with its code (Gao and Long, RaBitQ, 2024). The inner product with a query follows from the code alone, up to
an error of about 1 / sqrt(BITS). Candidates whose upper bound reaches the best exact values found are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import partitions, small_batches, stored, table

#: Bits of a code, as a multiple of 64; vectors of more components take as many bits as components at least.
BITS = 256
#: Bits of a query component.
PLANES = 4
#: Bounds lie this many standard deviations from the estimate: one true neighbour in a thousand may lie beyond.
DEVIATIONS = 3.0
#: Candidates that one task compares with a block of queries, and queries of a block.
PART, QUERIES = 1 << 16, 32

INDEX = "dim int, part long, id long, vec binary, code binary, ones int, fix double, off double"
BLOCK = "dim int, q array<long>, ids array<long>, vecs binary, planes binary, scalars binary"


def bits(dim: int) -> int:
    return max(BITS, -(-dim // 64) * 64)


_ROTATIONS: dict[int, np.ndarray] = {}


def rotation(dim: int) -> np.ndarray:
    """``dim`` orthonormal rows in ``bits(dim)`` dimensions: a random rotation of the zero-padded space, fixed per width."""
    if dim not in _ROTATIONS:
        square = np.random.default_rng(dim).standard_normal((bits(dim), dim))
        _ROTATIONS[dim] = np.linalg.qr(square)[0].T
    return _ROTATIONS[dim]


def norms(rows: np.ndarray) -> np.ndarray:
    return np.sqrt(np.cumsum(rows * rows, axis=1)[:, -1])


def encoded(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs as words, their number of ones, the factor that corrects an estimate, and the deviation of its error."""
    turned = unit @ rotation(unit.shape[1])
    width = turned.shape[1]
    code = np.packbits(turned > 0, axis=1).view(np.uint64)
    own = np.abs(turned).sum(axis=1) / np.sqrt(width)
    return code, np.bitwise_count(code).sum(axis=1).astype(np.int32), 1 / own, np.sqrt(np.maximum(0, 1 - own**2) / (width - 1)) / own


def quantized(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Queries as bit planes (query, plane, word) and scalars: low, step, sum of levels, deviation that rounding adds."""
    turned = unit @ rotation(unit.shape[1])
    width = turned.shape[1]
    low = turned.min(axis=1)
    step = np.maximum((turned.max(axis=1) - low) / ((1 << PLANES) - 1), 1e-300)
    level = np.rint((turned - low[:, None]) / step[:, None]).astype(np.uint8)
    lost = turned - (low[:, None] + step[:, None] * level)
    planes = np.stack([np.packbits(level >> p & 1, axis=1).view(np.uint64) for p in range(PLANES)], axis=1)
    return planes, np.stack([low, step, level.sum(axis=1, dtype=np.int64), norms(lost) / np.sqrt(width)], axis=1)


def estimates(code: np.ndarray, ones: np.ndarray, fix: np.ndarray, planes: np.ndarray, scalars: np.ndarray) -> np.ndarray:
    """Estimated cosines (query, candidate) from packed bits; ``code`` is (word, candidate)."""
    width = 64 * len(code)
    both = np.zeros((len(planes), code.shape[1]), np.int32)
    for p in range(PLANES):
        count = np.zeros(both.shape, np.uint16)
        for word in range(len(code)):
            count += np.bitwise_count(code[word][None, :] & planes[:, p, word][:, None])
        both += count.astype(np.int32) << p
    low, step, levels, _ = scalars.T
    inner = 2 * low[:, None] * ones[None, :] - (width * low)[:, None] + 2 * step[:, None] * both - (step * levels)[:, None]
    return inner / np.sqrt(width) * fix[None, :]


def _components(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column])


def _index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for dim, rows in batch.groupby("dim"):
            vec = _components(rows["vec"])
            code, ones, fix, off = encoded(vec / norms(vec)[:, None])
            out = {"dim": dim, "part": rows["part"].to_numpy(), "id": rows["id"].to_numpy(), "vec": [v.tobytes() for v in vec]}
            yield pd.DataFrame(out | {"code": [c.tobytes() for c in code], "ones": ones, "fix": fix, "off": off})


def _queries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for dim, rows in batch.groupby("dim"):
            vec = _components(rows["vec"])
            planes, scalars = quantized(vec / norms(vec)[:, None])
            one = (dim, rows["q"].tolist(), rows["id"].tolist(), vec.tobytes(), planes.tobytes(), scalars.tobytes())
            yield pd.DataFrame([one], columns=["dim", "q", "ids", "vecs", "planes", "scalars"])


def cosines(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """In double precision, products added from the first component to the last."""
    return np.cumsum(rows * query, axis=1)[:, -1] / (norms(rows) * norms(query[None, :])[0])


class Part:
    """The candidates of one task."""

    def __init__(self, rows: pd.DataFrame):
        order = np.argsort(rows["id"].to_numpy(), kind="stable")
        rows = rows.iloc[order]
        self.id = rows["id"].to_numpy(np.int64)
        self.vec = np.frombuffer(b"".join(rows["vec"]), np.float64).reshape(len(rows), -1)
        self.unit = self.vec / norms(self.vec)[:, None]
        self.code = np.ascontiguousarray(np.frombuffer(b"".join(rows["code"]), np.uint64).reshape(len(rows), -1).T)
        self.ones, self.fix, self.off = (rows[c].to_numpy() for c in ("ones", "fix", "off"))

    def best(self, block, n: int, deviations: float) -> Iterator[tuple[int, int, int, float]]:
        """(q, query id, candidate id, cosine) of the ``n`` best of every query of the block."""
        many = len(block.q)
        queries = np.frombuffer(block.vecs, np.float64).reshape(many, -1)
        planes = np.frombuffer(block.planes, np.uint64).reshape(many, PLANES, -1)
        scalars = np.frombuffer(block.scalars, np.float64).reshape(many, -1)
        guess = estimates(self.code, self.ones, self.fix, planes, scalars)
        for k in range(many):
            query = queries[k]
            own = guess[k]
            # the query's own row: one candidate of its id and components
            low, high = np.searchsorted(self.id, [block.ids[k], block.ids[k] + 1])
            itself = next((i for i in range(low, high) if np.array_equal(self.vec[i], query)), None)
            if itself is not None:
                own[itself] = -np.inf
            some = len(own) - (itself is not None)
            if some <= 0:
                continue
            unit = query / norms(query[None, :])[0]
            first = np.argpartition(-own, min(n, some) - 1)[: min(n, some)]
            reach = (self.unit[first] @ unit).min()  # of all candidates, n are at least as near as this
            slack = deviations * np.sqrt(self.off**2 + (scalars[k, 3] * self.fix) ** 2)
            near = np.union1d(np.flatnonzero(own + slack >= reach), first)
            exact = self.unit[near] @ unit
            if len(near) > n:  # leave out what rounding cannot bring back
                near = near[exact >= np.partition(exact, len(exact) - n)[len(exact) - n] - 1e-9]
            score = cosines(self.vec[near], query)
            for i in np.lexsort((self.id[near], -score))[:n]:
                yield block.q[k], block.ids[k], int(self.id[near[i]]), float(score[i])


FOUND = "q long, query_id long, vec_id long, score double"


def _search(batches: Iterator[pd.DataFrame], n: int, deviations: float) -> Iterator[pd.DataFrame]:
    """Rows sorted by (dim, part, kind): the candidates of a part, then the blocks of queries that meet it."""
    held, name, part = [], None, None
    for batch in batches:
        out = []
        for (dim, number, kind), rows in batch.groupby(["dim", "part", "kind"]):
            if (dim, number) != name:
                held, name, part = [], (dim, number), None
            if kind == 0:
                held.append(rows)
                continue
            if part is None and held:
                part, held = Part(pd.concat(held, ignore_index=True)), []
            if part is not None:
                for block in rows.itertuples(index=False):
                    out += part.best(block, n, deviations)
        yield pd.DataFrame(out, columns=["q", "query_id", "vec_id", "score"])


def usable(vectors: DataFrame, id: str, vector: str) -> DataFrame:
    """``(id, dim, vec)`` of the vectors that take part."""
    rows = vectors.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec"))
    finite = F.coalesce(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    square = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)
    rows = rows.where(F.col("id").isNotNull() & F.col("vec").isNotNull() & finite)
    return rows.where((square > 0) & (square < float("inf"))).select("id", F.size("vec").alias("dim"), "vec")


def nearest_vectors(
    queries: DataFrame, vectors: DataFrame, n: int = 5, id: str = "vec_id", vector: str = "embedding",
    part: int = PART, deviations: float = DEVIATIONS,
) -> DataFrame:
    """The ``n`` vectors nearest to each query by cosine: ``(query_id, rank, vec_id, score)``, ties to the smaller id.

    A query does not find its own row: one row of its id and components. Rows take part that have an id and a finite,
    non-zero vector whose squared length is a double above 0; a query meets vectors of its own width. All other columns
    are left out. Of equal vectors only the n + 1 smallest ids can be among a query's nearest, so copies go no further
    than that. A repeated query row is answered once per row. Empty tables give an empty result.

    Candidates are dealt evenly into parts; every block of queries meets every part. A part hands on n rows per query.
    """
    spark = vectors.sparkSession
    small_batches(spark, rows=4096, mb=16)
    rows = usable(vectors, id, vector)
    copies = W.partitionBy("vec").orderBy("id")
    kept = stored(rows.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= n + 1).drop("copy"), "candidates")
    parts = max(partitions(spark), -(-kept.count() // part))
    kept = kept.withColumn("part", F.pmod(F.xxhash64("vec", "id"), F.lit(parts)))
    index = stored(kept.mapInPandas(_index, INDEX), "index")
    small_batches(spark, rows=QUERIES, mb=8)
    asked = stored(usable(queries, id, vector).withColumn("q", F.monotonically_increasing_id()), "queries")
    blocks = stored(asked.mapInPandas(_queries, BLOCK), "query_blocks")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))
    # numbers are never NULL, so that pandas keeps them as they are
    left = index.withColumn("kind", F.lit(0))
    zeros = [F.lit(0).cast("long").alias("id"), F.lit(0).alias("ones"), *[F.lit(0.0).alias(c) for c in ("fix", "off")]]
    right = blocks.select("*", every.alias("part"), F.lit(1).alias("kind"), *zeros)
    rows = left.unionByName(right, allowMissingColumns=True).repartition("dim", "part").sortWithinPartitions("dim", "part", "kind")
    small_batches(spark, rows=1024, mb=8)
    found = stored(rows.mapInPandas(lambda batches: _search(batches, n, deviations), FOUND), "found")
    best = W.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op12_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest_vectors(vectors.where("vec_id % 50 = 0"), vectors)


#: Products and squares are added in order, as above.
ORACLE = """WITH v AS (SELECT vec_id, e, list_reduce(list_transform(e, lambda x: x * x), lambda a, b: a + b) AS s FROM (
    SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding))
    WHERE s > 0 AND vec_id IS NOT NULL)
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM (
    SELECT q.vec_id AS query_id, v.vec_id, list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * v.e[i]),
    lambda a, b: a + b) / (sqrt(v.s) * sqrt(q.s)) AS score
    FROM v q JOIN v ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id AND len(v.e) = len(q.e)) QUALIFY rank <= 5"""
