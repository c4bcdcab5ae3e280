"""Sums of word weights over the distinct words of a document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import union_all
from .skew import hot_keys, split_join

# A weight table of at most this many rows is broadcast (some 60 MB).
BROADCAST_ROWS = 1_000_000


def weight_sums(docs: DataFrame, weights: DataFrame, values: list[str], size: int, most: int | None = None) -> DataFrame:
    """The columns of ``docs`` but ``tokens``, which must identify the row, with the sums of ``values`` over its words.

    ``weights`` has ``feature`` and ``values``, ``size`` rows. A document without any of its words has NULL. Explode
    keeps a document in its task, so partial aggregation leaves one narrow row per document to shuffle. A table of at
    most ``most`` rows is broadcast; beyond that, words frequent in ``docs`` are answered from a bounded broadcast and the
    rest by a shuffle join.
    """
    keys = [c for c in docs.columns if c != "tokens"]
    words = F.array_distinct("tokens")
    if size <= (BROADCAST_ROWS if most is None else most):
        rows = docs.select(*keys, F.explode_outer(words).alias("feature"))
        x = rows.join(F.broadcast(weights), "feature", "left")
    else:
        rows = docs.select(*keys, F.explode(words).alias("feature"))
        # frequent in the corpus that is scored, seen in training or not
        hot = hot_keys(rows.groupBy("feature").agg(F.count("*").alias("n"))).select("feature")
        x = split_join(rows, weights, "feature", hot)
        none = [F.lit(None).cast("double").alias(v) for v in values]
        x = union_all(x.select(*keys, *values), docs.select(*keys, *none))
    return x.groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values])
