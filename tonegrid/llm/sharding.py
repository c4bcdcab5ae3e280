"""Shards of near equal size: sampled splitters, range partitioning, overfull ranges cut again."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import partitions, stored, table

SHARDS = 16
#: Ranges at least, and expected samples per range; what the driver sees is bounded by their product.
RANGES, OVERSAMPLE = 2048, 24
#: A range over this many times the mean size is cut again.
OVERFULL = 3


def sampled(rows: DataFrame, wanted: float, total: int, seed: int) -> pd.DataFrame:
    """About ``wanted`` (key, id) pairs, drawn with chances in proportion to ``size`` by a hash of the row."""
    chance = F.col("size") * F.lit(wanted / max(total, 1))
    draw = F.pmod(F.xxhash64("key", "id", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    return rows.where(draw < chance).select("key", "id").toPandas().sort_values(["key", "id"])


def splitters(sample: pd.DataFrame, ranges: int) -> pd.DataFrame:
    """Quantiles of the sample. A key drawn only once as a splitter cuts before its whole group."""
    if not len(sample):
        return sample
    at = np.unique(np.linspace(0, len(sample), ranges + 1)[1:-1].astype(np.int64))
    cut = sample.iloc[at].drop_duplicates()
    once = ~cut["key"].duplicated(keep=False)
    cut = cut.assign(id=cut["id"].where(~once, np.iinfo(np.int64).min))
    return cut.sort_values(["key", "id"])


def range_of(cuts: pd.DataFrame):
    """Number of splitters at or before (key, id): binary search on the key, then on ids under a repeated key."""
    keys, ids = cuts["key"].to_numpy(np.int64), cuts["id"].to_numpy(np.int64)

    @F.pandas_udf("long")
    def find(key: pd.Series, id_: pd.Series) -> pd.Series:
        k, i = key.to_numpy(), id_.to_numpy()
        low, high = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
        out = low.copy()
        for value in np.unique(k[low < high]):
            rows = np.flatnonzero(k == value)
            a, b = low[rows[0]], high[rows[0]]
            out[rows] = a + np.searchsorted(ids[a:b], i[rows], "right")
        return pd.Series(out)

    return find("key", "id")


def sharded(rows: DataFrame, shards: int = SHARDS, ranges: int = RANGES) -> DataFrame:
    """``rows`` (a stored table with key, id, size) plus ``shard`` and ``slot``; shards hold near equal bytes.

    Shards are stretches of the (key, id) order. A key group takes the shard of its middle byte as a whole, unless it
    alone spans several ranges: then it is cut between its rows. Equal (key, id) rows stay apart by a row number.
    """
    total, count = rows.agg(F.sum("size"), F.count("*")).first()
    if not count:
        return rows.select("*", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    ranges = max(ranges, partitions(rows.sparkSession))
    sample = sampled(rows, ranges * OVERSAMPLE, total, 0)
    cuts = splitters(sample, ranges)
    limit = OVERFULL * total / ranges
    for again in range(1, 5):
        placed = rows.withColumn("__range", range_of(cuts))
        full = placed.groupBy("__range").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
        full = full.where((F.col("b") > limit) & (F.col("n") > 1)).select("__range")
        more = sampled(placed.join(F.broadcast(full), "__range", "left_semi"), ranges * OVERSAMPLE * 4**again, total, again)
        if not len(more):
            break
        extra = more.iloc[:: max(1, OVERSAMPLE * 4**again // 2)]
        cuts = pd.concat([cuts, extra]).drop_duplicates().sort_values(["key", "id"])
    split = cuts.loc[cuts["key"].duplicated(keep=False), "key"].unique()
    placed = rows.withColumn("__range", range_of(cuts))
    order = W.partitionBy("__range").orderBy("key", "id")
    upto = order.rowsBetween(W.unboundedPreceding, -1)
    placed = placed.withColumn("__bytes", F.coalesce(F.sum("size").over(upto), F.lit(0)))
    placed = stored(placed.withColumn("__row", F.row_number().over(order) - 1), "ranges")
    sizes = placed.groupBy("__range").agg(F.sum("size").alias("b"), F.count("*").alias("n")).toPandas().sort_values("__range")
    ahead = pd.DataFrame(
        {"__range": sizes["__range"], "__b0": sizes["b"].cumsum() - sizes["b"], "__n0": sizes["n"].cumsum() - sizes["n"]}
    )
    spark = rows.sparkSession
    placed = placed.join(F.broadcast(spark.createDataFrame(ahead, "__range long, __b0 long, __n0 long")), "__range")
    position = F.col("__b0") + F.col("__bytes")
    cut = spark.createDataFrame(pd.DataFrame({"key": split}), "key long").withColumn("__split", F.lit(True))
    placed = placed.join(F.broadcast(cut), "key", "left")
    group = W.partitionBy("__range", "key", F.when(F.col("__split"), F.col("__row")))
    first, size = F.min(position).over(group), F.sum("size").over(group)
    shard = F.least(F.floor((2 * first + size) * shards / (2 * total)), F.lit(shards - 1)).cast("int")
    placed = stored(placed.select(*rows.columns, (F.col("__n0") + F.col("__row")).alias("__at"), shard.alias("shard")), "shards")
    starts = placed.groupBy("shard").agg(F.min("__at").alias("__first"))  # at most `shards` rows
    placed = placed.join(F.broadcast(starts), "shard")
    return placed.select(*rows.columns, "shard", (F.col("__at") - F.col("__first")).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Documents (doc_id, text) as (doc_id, size, text_crc32, shard, slot), groups of equal texts kept together.

    Size is the bytes of the text plus one; a NULL text has none. NULL ids come before all others. An empty table
    gives no row.
    """
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = docs.select(
        "doc_id",
        (F.length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63) + 1)).alias("id"),
    )
    return sharded(stored(rows, "sizes"), shards).drop("key", "id")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
