"""Helpers shared by the training-data operators: tables, stored intermediates, batches, row keys."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import delete, scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: lineage ends there and lost executors cost nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove ``stored`` tables that nothing reads any more."""
    for df in tables:
        for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            delete(df.sparkSession, folder)


def small_batches(spark: SparkSession, rows: int = 1024, mb: int = 8) -> None:
    """Bound what one Arrow batch holds, whatever the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))


def released(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``work`` on batches; when it ends, what it has freed goes back to the system.

    Workers are kept from task to task and from stage to stage, and allocators keep what has been freed.
    """

    def run(batches: Iterator) -> Iterator:
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return run


def utf8(column: str = "text"):
    """A text column as its UTF-8 bytes, NULL as none."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def shards(batches: Iterator[pd.DataFrame], column: str, limit: int) -> Iterator[pd.DataFrame]:
    """Regroup batches into frames of about ``limit`` bytes of ``column``; a longer value is a frame of its own."""
    held: list[pd.DataFrame] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += int(batch[column].map(len).sum())
        if size >= limit:
            yield pd.concat(held, ignore_index=True)
            held, size = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


class Memo(dict):
    """A dictionary that computes missing values and starts anew when it holds ``limit`` of them."""

    def __init__(self, compute: Callable, limit: int = 300_000):
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, key):
        value = self.compute(key)
        if len(self) >= self.limit:
            self.clear()
        self[key] = value
        return value


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_key(docs: DataFrame, key: str = "__key", by: str = "doc_id") -> DataFrame:
    """``docs`` with a unique long ``key`` that follows (doc_id, text), NULL ids first.

    Unique ids without NULL are the key themselves. Otherwise rows are range-sorted and numbered, partition
    by partition, so that repeated ids and wholly equal rows stay apart.
    """
    repeated = docs.groupBy(by).count().where(f"count > 1 OR {by} IS NULL")
    if repeated.isEmpty():
        return docs.withColumn(key, F.col(by).cast("long"))
    order = [c for c in (by, "text") if c in docs.columns]
    ranged = docs.withColumn("__salt", F.monotonically_increasing_id()).repartitionByRange(partitions(docs.sparkSession), *order, "__salt")
    ranged = ranged.sortWithinPartitions(*order).drop("__salt")
    return stored(ranged.withColumn(key, F.monotonically_increasing_id()), "keyed")


def offsets(lengths) -> np.ndarray:
    """Starts of consecutive runs, with the total last."""
    return np.concatenate([[0], np.cumsum(np.asarray(lengths, dtype=np.int64))]).astype(np.int64)
