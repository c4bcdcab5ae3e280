"""Word and adjacent-pair counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..session import NEG, POS, delete, scratch_path, union_all
from .skew import with_next


def word_freq(docs: DataFrame) -> DataFrame:
    return text.token_rows(docs).groupBy("token").agg(F.count("*").alias("n"))


def class_counts(rows: DataFrame, key: str = "token") -> DataFrame:
    """Counts per class side by side: ``(key, n_pos, n_neg, n)``."""
    return rows.groupBy(key).agg(
        F.count_if(F.col("label") == POS).alias("n_pos"),
        F.count_if(F.col("label") == NEG).alias("n_neg"),
        F.count("*").alias("n"),
    )


def class_word_freq(docs: DataFrame) -> DataFrame:
    return class_counts(text.token_rows(docs, "label"))


def class_totals(docs: DataFrame) -> DataFrame:
    """Tokens per class and, with a NULL label, over all. Reads array sizes only."""
    return docs.rollup("label").agg(F.sum(F.size("tokens")).cast("long").alias("n"))


def by_class(counts: DataFrame, key: str = "token") -> DataFrame:
    """Long form ``(label, key, n)`` of a count table, zero counts left out."""
    sides = F.array(*[F.struct(F.lit(c).alias("label"), F.col(f"n_{c}").alias("n")) for c in (POS, NEG)])
    return counts.select(key, F.inline(sides)).where("n > 0").select("label", key, "n")


def border_pairs(ends: DataFrame) -> DataFrame:
    """Each document's last word with the first of the next, documents in ``doc_id`` order: ``(label, w1, w2)``.

    ``ends`` is a stored table with one narrow row ``(label, doc_id, first, w1)`` per document that has words. The last word
    of a class has no next one.
    """
    return with_next(ends, "label", "doc_id", "first", "w2").select("label", "w1", "w2")


def corpus_counts(docs: DataFrame, cross_docs: bool = True) -> tuple[DataFrame, DataFrame]:
    """``(token, n_pos, n_neg, n)`` and ``(label, w1, w2, n)`` of a corpus, from one tokenisation and one count.

    Every word starts one pair: with the next word of its document or, the last one, across the border (with
    ``cross_docs``) or with nothing. So the counts of words are sums of those of pairs. Tokens are stored while borders
    are found and go when the counts are written.
    """
    spark = docs.sparkSession
    size = F.greatest(F.size("tokens") - 1, F.lit(0))
    tokens = docs.select("label", "doc_id", "tokens", F.get("tokens", F.lit(0)).alias("first"), F.get("tokens", F.size("tokens") - 1).alias("w1"))
    texts, path = scratch_path(spark, "tokens"), scratch_path(spark, "counts")
    tokens.write.parquet(texts)
    tokens = spark.read.schema(tokens.schema).parquet(texts)
    ends = tokens.where("size(tokens) > 0").select("label", "doc_id", "first", "w1")
    last = border_pairs(ends) if cross_docs else ends.select("label", "w1", F.lit(None).cast("string").alias("w2"))
    pairs = F.arrays_zip(F.slice("tokens", F.lit(1), size).alias("w1"), F.slice("tokens", F.lit(2), size).alias("w2"))
    inner = tokens.select("label", F.explode(pairs).alias("p")).select("label", "p.w1", "p.w2")
    rows = union_all(inner, last).groupBy("label", "w1", "w2").agg(F.count("*").alias("n"))
    rows.write.parquet(path)
    delete(spark, texts)
    counts = spark.read.schema(rows.schema).parquet(path)
    sides = [F.coalesce(F.sum(F.when(F.col("label") == c, F.col("n"))), F.lit(0)).alias(f"n_{c}") for c in (POS, NEG)]
    words = counts.groupBy(F.col("w1").alias("token")).agg(*sides, F.sum("n").alias("n"))
    return words, counts.where("w2 IS NOT NULL")


def bigram_freq(docs: DataFrame, cross_docs: bool = True) -> DataFrame:
    """Adjacent pairs per class: ``(label, w1, w2, n)``.

    With ``cross_docs`` the class is one long token sequence, as if its documents were chained.
    """
    if cross_docs:
        return corpus_counts(docs)[1]
    inside = docs.select("label", F.explode(text.bigrams(F.col("tokens"))).alias("p"))
    pairs = inside.select("label", F.col("p")[0].alias("w1"), F.col("p")[1].alias("w2"))
    return pairs.groupBy("label", "w1", "w2").agg(F.count("*").alias("n"))
