"""Complete feature selection: words and pairs by chi-square, then word-vector neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.association import best, word_bigram_scores
from ..operators.vectors import expand_features
from ..session import GROUP_LIMIT, materialize


def select_features(
    docs: DataFrame,
    k: int = 700,
    vectors: DataFrame | None = None,
    neighbours: int = 10,
    pairs: int = GROUP_LIMIT,
    cross_docs: bool = True,
    negative_pairs_only: bool = False,
) -> DataFrame:
    """``(feature, rank, source)``: the ``k`` best features, plus the neighbours of their words."""
    scores = word_bigram_scores(docs, pairs, cross_docs, negative_pairs_only)
    chosen = materialize(best(scores, k).select("feature", "rank"))  # k rows, read many times
    if vectors is None:
        return chosen.withColumn("source", F.lit("selected"))
    return expand_features(chosen, vectors, neighbours)
