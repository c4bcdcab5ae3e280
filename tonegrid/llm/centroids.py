"""Centroid clustering of integer vectors: every distance is read from tables of squared differences.

Vectors lie in blocks. A block keeps, per dimension, the integers that occur in it and each vector's place among them.
A round tabulates the squared difference of every occurring integer to every centroid; the distances of a block are then
gathered from these tables and added up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, stored, table

#: Vectors of a block; their places among the occurring integers fit 16 bits.
BLOCK = 8192
#: Components of which the integer is beyond this stay at it, so that a squared distance of 64 of them fits a long.
LARGEST = 1 << 27
LONGEST = (1 << 63) - 1

BLOCKS = "ids array<long>, places binary, values binary, sizes array<int>"


def whole(vector: str, width: int):
    """The condition on rows that take part: exactly ``width`` components, none NULL, NaN or infinite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    doubles = F.col(vector).cast("array<double>")
    return F.col(vector).isNotNull() & (F.size(vector) == width) & F.coalesce(F.forall(doubles, finite), F.lit(False))


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    return np.clip(np.floor(values.astype(np.float64) * scale), -LARGEST, LARGEST).astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], width: int, scale: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = integers(batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(-1, width), scale)
        places, values = [], []
        for column in rows.T:
            own, at = np.unique(column, return_inverse=True)
            values.append(own)
            places.append(at.astype(np.uint16))
        out = {
            "ids": pa.array([batch.column("id").to_pylist()], pa.list_(pa.int64())),
            "places": pa.array([np.stack(places).tobytes()], pa.binary()),
            "values": pa.array([np.concatenate(values).tobytes()], pa.binary()),
            "sizes": pa.array([[len(v) for v in values]], pa.list_(pa.int32())),
        }
        yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))


def squared_differences(values: np.ndarray, sizes: np.ndarray, centroids: np.ndarray) -> list[np.ndarray]:
    """Per dimension the table (occurring integer, centroid)."""
    parts = np.split(values, np.cumsum(sizes)[:-1])
    return [(own[:, None] - centroids[None, :, d]) ** 2 for d, own in enumerate(parts)]


def nearest(tables: list[np.ndarray], places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector, the smaller number among equals, and the distance."""
    total = np.zeros((places.shape[1], tables[0].shape[1]), np.int64)
    for own, at in zip(tables, places):
        total += own[at]
    best = total.argmin(axis=1)
    return best, total[np.arange(len(total)), best]


def _assigned(block, centroids: np.ndarray):
    sizes = np.asarray(block.sizes, np.int64)
    values = np.frombuffer(block.values, np.int64)
    places = np.frombuffer(block.places, np.uint16).reshape(len(sizes), -1)
    return *nearest(squared_differences(values, sizes, centroids), places), values, sizes, places


def _sums(batches: Iterator[pd.DataFrame], centroids: np.ndarray) -> Iterator[pd.DataFrame]:
    """Per block and non-empty cluster: vectors and componentwise sums."""
    for batch in batches:
        out = []
        for block in batch.itertuples(index=False):
            best, _, values, sizes, places = _assigned(block, centroids)
            starts = np.cumsum(sizes) - sizes
            rows = np.stack([values[s:][at] for s, at in zip(starts, places)], axis=1)
            for cluster in np.unique(best):
                own = rows[best == cluster]
                out.append((int(cluster), len(own), own.sum(axis=0)))
        yield pd.DataFrame(out, columns=["cluster", "n", "sums"])


def _labels(batches: Iterator[pd.DataFrame], centroids: np.ndarray) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for block in batch.itertuples(index=False):
            best, distance, *_ = _assigned(block, centroids)
            yield pd.DataFrame({"id": pd.array(block.ids, "Int64"), "cluster": best, "distance": distance})


def moved(centroids: np.ndarray, blocks: DataFrame) -> np.ndarray:
    """One round: non-empty centroids become the floor of the mean of their vectors. k x width numbers reach the driver."""
    k, width = centroids.shape
    sums = blocks.mapInPandas(lambda batches: _sums(batches, centroids), "cluster int, n long, sums array<long>")
    added = [F.sum(F.get("sums", F.lit(d)).cast("decimal(38,0)")).alias(f"s{d}") for d in range(width)]
    out = centroids.copy()
    for row in sums.groupBy("cluster").agg(F.sum("n").alias("n"), *added).collect():
        out[row.cluster] = [int(row[f"s{d}"]) // row.n for d in range(width)]
    return out


def cluster(
    vectors: DataFrame,
    k: int,
    rounds: int,
    width: int,
    scale: int = 256,
    seed: Callable = lambda id_: F.sha2(F.concat(F.lit("2:"), F.coalesce(id_.cast("string"), F.lit(""))), 256),
    id: str = "vec_id",
    vector: str = "embedding",
    block: int = BLOCK,
) -> tuple[DataFrame, np.ndarray]:
    """``(id, cluster, distance)`` of every vector that takes part (see ``whole``), and the final centroids.

    Components become floor(scale * x). The first centroids are the ``k`` vectors with the smallest ``seed`` of their
    id; equal seeds (repeated ids) go by components. With fewer vectors there are fewer centroids. A NULL id takes part
    and hashes as an empty one; equal rows are vectors of their own; other columns are left out. An empty table, or one
    without a whole vector, gives an empty result and no centroid.
    """
    kept = vectors.where(whole(vector, width)).select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec"))
    spark = vectors.sparkSession
    first = kept.orderBy(seed(F.col("id")), "vec").limit(k).select("vec").collect()
    centroids = integers(np.array([r.vec for r in first]).reshape(-1, width), scale)
    if not len(centroids):
        return spark.createDataFrame([], "id long, cluster int, distance long"), centroids
    small_batches(spark, rows=block, mb=64)
    blocks = stored(kept.mapInArrow(lambda batches: _blocks(batches, width, scale), BLOCKS), "vector_blocks")
    small_batches(spark, rows=8, mb=16)
    for _ in range(rounds):
        centroids = moved(centroids, blocks)
    final = centroids
    return blocks.mapInPandas(lambda batches: _labels(batches, final), "id long, cluster int, distance long"), centroids


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centroids = cluster(table(spark, sf_dir, "embeddings"), k=40, rounds=5, width=64)
    rows = stored(rows, "clustered")
    sums = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(28,0)")).alias("sum")).collect()
    inertia = sum(int(r["sum"]) for r in sums)
    # one row per cluster; a sum that passes a long stays at its largest value
    named = [(r.cluster, min(int(r["sum"]), LONGEST), min(inertia, LONGEST), digest(centroids[r.cluster])) for r in sums]
    report = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = rows.join(F.broadcast(report), "cluster")
    return out.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = 40, rounds: int = 5, width: int = 64) -> str:
    """The same rounds as a chain of common table expressions."""
    steps = [
        f"""v AS MATERIALIZED (SELECT vec_id, generate_subscripts(embedding, 1) AS d, floor(256 * unnest(embedding)::DOUBLE)::BIGINT AS x
        FROM embeddings WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda e: isfinite(e))) = {width})""",
        f"""c0 AS MATERIALIZED (SELECT c, d, x FROM v JOIN (SELECT vec_id, row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c
        FROM (SELECT DISTINCT vec_id FROM v) QUALIFY c < {k}) USING (vec_id))""",
    ]
    for r in range(rounds + 1):
        steps.append(
            f"""a{r} AS MATERIALIZED (SELECT vec_id, min(struct_pack(s := s, c := c)) AS m FROM (
            SELECT vec_id, c, sum((v.x - p.x) * (v.x - p.x))::BIGINT AS s FROM v JOIN c{r} p USING (d) GROUP BY vec_id, c) GROUP BY vec_id)"""
        )
        if r < rounds:
            steps.append(
                f"""c{r + 1} AS MATERIALIZED (SELECT p.c, p.d, coalesce(n.x, p.x) AS x FROM c{r} p LEFT JOIN (SELECT m.c AS c, d,
                ((sum(x) - (((sum(x) % count(*)) + count(*)) % count(*))) // count(*))::BIGINT AS x FROM a{r} JOIN v USING (vec_id) GROUP BY m.c, d) n
                ON n.c = p.c AND n.d = p.d)"""
            )
    return (
        "WITH "
        + ",\n".join(steps)
        + f""", names AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY d)) AS h FROM c{rounds} GROUP BY c)
        SELECT vec_id, m.c::INT AS cluster, m.s AS distance, sum(m.s) OVER (PARTITION BY m.c)::BIGINT AS cluster_inertia,
        sum(m.s) OVER ()::BIGINT AS inertia, h AS centroid_sha256 FROM a{rounds} JOIN names ON names.c = m.c"""
    )
