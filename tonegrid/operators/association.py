"""Chi-square association of words and pairs with the classes, and top-k selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import chi_square
from ..session import GROUP_LIMIT, NEG, POS, materialize, tune, union_all
from .counts import by_class, class_word_freq, corpus_counts
from .skew import hot_keys, lookup, top_n

DIGITS = 6


def class_scores(counts: DataFrame) -> DataFrame:
    """Add ``score`` to a ``(…, n_pos, n_neg, n)`` table.

    The statistic of one class equals that of the other (only the sign inside the square
    changes), so the sum over both is twice the one computed here.

    The table is read twice (totals, then scores), so it should be a stored one.
    """
    n_pos, n_all = counts.agg(F.sum("n_pos"), F.sum("n")).first()
    chi2 = chi_square(F.col("n_pos"), F.col("n"), F.lit(n_pos), F.lit(n_all))
    return counts.withColumn("score", F.round(2.0 * chi2, DIGITS))


def word_scores(docs: DataFrame) -> DataFrame:
    """``(token, n_pos, n_neg, n, score)``"""
    return class_scores(materialize(class_word_freq(docs)))


def best(scores: DataFrame, k: int, key: str = "feature") -> DataFrame:
    """The ``k`` highest scores with their rank, ties by key."""
    top = scores.orderBy(F.desc_nulls_last("score"), key).limit(k)
    # at most k rows reach this window
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc_nulls_last("score"), key)))


def bigram_scores(docs: DataFrame, cross_docs: bool = True) -> DataFrame:
    """Association of the two words of each pair inside its class: ``(label, w1, w2, n, n1, n2, score)``."""
    words, pairs = corpus_counts(docs, cross_docs)
    return pair_scores(materialize(words), pairs)


def pair_scores(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """``bigram_scores`` from the stored word counts and the pair counts of a corpus."""
    words = by_class(words)
    totals = words.groupBy("label").agg(F.sum("n").alias("n_all"))
    hot = hot_keys(words)
    first = words.select("label", F.col("token").alias("w1"), F.col("n").alias("n1"))
    second = words.select("label", F.col("token").alias("w2"), F.col("n").alias("n2"))
    hot1 = hot.select("label", F.col("token").alias("w1"), F.col("n").alias("n1"))
    hot2 = hot.select("label", F.col("token").alias("w2"), F.col("n").alias("n2"))
    x = lookup(pairs, first, ["label", "w1"], ["n1"], hot1, F.col("w2"))
    x = lookup(x, second, ["label", "w2"], ["n2"], hot2, F.col("w1"))
    x = x.join(F.broadcast(totals), "label")  # one row per class
    score = chi_square(F.col("n"), F.col("n1"), F.col("n2"), F.col("n_all"))
    return x.select("label", "w1", "w2", "n", "n1", "n2", F.round(score, DIGITS).alias("score"))


def top_bigrams(docs: DataFrame, n: int = GROUP_LIMIT, cross_docs: bool = True) -> DataFrame:
    """The ``n`` best pairs of each class, ties by pair."""
    return best_pairs(bigram_scores(docs, cross_docs), n)


def best_pairs(scores: DataFrame, n: int) -> DataFrame:
    tune(scores.sparkSession)
    return top_n(scores, ["label"], [F.desc_nulls_last("score"), F.asc("w1"), F.asc("w2")], n)


def word_bigram_scores(
    docs: DataFrame, n: int = GROUP_LIMIT, cross_docs: bool = True, negative_pairs_only: bool = False
) -> DataFrame:
    """Scores of words and of each class's best pairs: ``(feature, n_pos, n_neg, n, score)``.

    A selected pair is appended once to its class's word list, so it counts 1 there and raises the
    class total by 1. ``negative_pairs_only`` gives both classes the pairs of the negative corpus,
    as one of the known implementations of this scoring does.
    """
    words, found = corpus_counts(docs, cross_docs)
    words = materialize(words)
    pairs = best_pairs(pair_scores(words, found), n).select("label", F.array("w1", "w2").alias("feature"))
    if negative_pairs_only:
        pairs = pairs.where(F.col("label") == NEG).select(F.explode(F.array(F.lit(POS), F.lit(NEG))).alias("label"), "feature")
    pair_counts = pairs.groupBy("feature").agg(
        F.count_if(F.col("label") == POS).alias("n_pos"),
        F.count_if(F.col("label") == NEG).alias("n_neg"),
        F.count("*").alias("n"),
    )
    words = words.select(F.array("token").alias("feature"), "n_pos", "n_neg", "n")
    return class_scores(union_all(words, materialize(pair_counts)))
