"""Deterministic shuffles and train/test splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import union_all
from .skew import hash_blocks, hash_key

BLOCK_DIGITS = 3  # 4096 hash blocks per group


def shuffled(df: DataFrame, seed: int = 0, key: str = "doc_id", digits: int = BLOCK_DIGITS) -> DataFrame:
    """Add ``position`` (1..n), a seeded random order of the rows.

    The order is that of a hash of ``key``. Hash blocks are even, so each is ranked by its own task
    and shifted by the number of rows in the blocks before it.
    """
    x = df.withColumn("__h", hash_key(F.col(key), seed)).withColumn("__block", F.substring("__h", 1, digits))
    sizes = hash_blocks(df.select(hash_key(F.col(key), seed).alias("__h")), [], "__h", digits)
    inside = F.row_number().over(W.partitionBy("__block").orderBy("__h", key))
    x = x.withColumn("__i", inside).join(F.broadcast(sizes), "__block")  # 16**digits rows
    return x.select(*df.columns, (F.col("__before") + F.col("__i")).alias("position"))


def positional_split(
    df: DataFrame, fraction: float = 0.9, seed: int = 0, key: str = "doc_id", by: str = "label", digits: int = BLOCK_DIGITS
) -> DataFrame:
    """Add ``part``: per class, the first ``floor(fraction * n)`` rows in shuffled order are ``train``.

    Whole hash blocks fall on one side of the cut, so only the block holding the cut is ranked; the
    other rows are decided where they are, without a shuffle.
    """
    hashed = df.withColumn("__h", hash_key(F.col(key), seed))
    sizes = hash_blocks(hashed.select(by, "__h"), [by], "__h", digits)
    sizes = sizes.withColumn("__cut", F.floor(F.lit(fraction) * F.col("__all")))
    x = hashed.withColumn("__block", F.substring("__h", 1, digits))
    x = x.join(F.broadcast(sizes), [by, "__block"])  # 16**digits rows per class
    after = F.col("__before") + F.col("__n")
    on_cut = (F.col("__before") < F.col("__cut")) & (after > F.col("__cut"))
    side = F.when(after <= F.col("__cut"), "train").otherwise("test")
    sure = x.where(~on_cut).select(*df.columns, side.alias("part"))
    inside = F.row_number().over(W.partitionBy(by, "__block").orderBy("__h", key))
    ranked = x.where(on_cut).withColumn("__i", inside + F.col("__before"))
    ranked = ranked.select(*df.columns, F.when(F.col("__i") <= F.col("__cut"), "train").otherwise("test").alias("part"))
    return union_all(sure, ranked)


def random_split(df: DataFrame, fraction: float = 0.8, seed: int = 0, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The two parts of ``hash_split``; they cover every row once, whatever the partition layout."""
    both = hash_split(df, fraction, seed, key)
    return tuple(both.where(F.col("part") == part).drop("part") for part in ("train", "test"))


def hash_split(df: DataFrame, fraction: float = 0.8, seed: int = 0, key: str = "doc_id") -> DataFrame:
    """Add ``part`` by a threshold on the md5 of ``key``: narrow, stable under any repartitioning.

    Rows with equal keys, and all with a NULL key (test), share a side.
    """
    drawn = F.conv(F.substring(hash_key(F.col(key), seed), 1, 8), 16, 10).cast("long")
    return df.withColumn("part", F.when(drawn < int(fraction * (1 << 32)), "train").otherwise("test"))
