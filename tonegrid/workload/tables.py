"""The shared tables as inputs of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import class_name
from ..operators import association, corpus, counts
from ..operators.split import random_split
from ..plans import dense
from ..session import materialize, scratch_path
from ..sources.corpora import spread

K = 700
STOPWORDS = 50
LEXICON_SHARE = 2000  # a lexicon word is at least 1/2000 of all tokens
DIM = 64


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def raw_documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """``(doc_id, tokens)`` of every document."""
    return corpus.tokenize(raw_documents(spark, sf))


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """``(doc_id, label, tokens)`` of the labelled documents."""
    texts = corpus.labelled(raw_documents(spark, sf), table(spark, sf, "labels"))
    return corpus.tokenize(texts).select("doc_id", "label", "tokens")


def labelled_once(spark: SparkSession, sf: str) -> DataFrame:
    """The same, stored: texts are split into words once, however often they are read."""
    path = scratch_path(spark, "labelled")
    docs = labelled(spark, sf)
    docs.write.parquet(path)
    return spark.read.schema(docs.schema).parquet(path)


def classes(spark: SparkSession, sf: str) -> DataFrame:
    """``(doc_id, label)``"""
    return table(spark, sf, "labels").select("doc_id", class_name(F.col("quality")).alias("label"))


def raw_turns(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "conversations").select("conv_id", "turn", "text"), "conv_id")


def conversations(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.tokenize(raw_turns(spark, sf))


def stopwords(spark: SparkSession, sf: str) -> DataFrame:
    """The most frequent words of the corpus."""
    freq = counts.word_freq(documents(spark, sf))
    return freq.orderBy(F.desc("n"), "token").limit(STOPWORDS).select("token")


def lexicon(spark: SparkSession, sf: str) -> DataFrame:
    """Words of a minimum share of the corpus, so at most ``LEXICON_SHARE`` of them."""
    freq = materialize(counts.word_freq(documents(spark, sf)))
    total = freq.agg(F.sum("n").alias("t")).scalar()
    return freq.where(F.col("n") * LEXICON_SHARE >= total).select("token", F.col("n").alias("freq"), F.lit("x").alias("flag"))


def top_words(spark: SparkSession, sf: str, k: int = K) -> DataFrame:
    """``(feature, rank)`` of the k best single words."""
    return best_words(labelled(spark, sf), k)


def best_words(docs: DataFrame, k: int = K) -> DataFrame:
    scored = association.word_scores(docs).select(F.array("token").alias("feature"), "score")
    return association.best(scored, k).select("feature", "rank", "score")


def word_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """``(word, vec)``: a vector goes to the most frequent word whose hash selects it."""
    vectors = table(spark, sf, "embeddings")
    size = vectors.agg(F.count("*").alias("c")).scalar()
    slot = F.conv(F.substring(F.md5("token"), 1, 8), 16, 10).cast("long") % size
    freq = counts.word_freq(documents(spark, sf))
    first = freq.groupBy(slot.alias("vec_id")).agg(F.min(F.struct((-F.col("n")).alias("o"), "token")).alias("m"))
    named = first.select("vec_id", F.col("m.token").alias("word")).join(vectors, "vec_id")
    return materialize(named.select("word", F.col("embedding").alias("vec")))  # a stored table in real use


def dense_rows(spark: SparkSession, sf: str) -> DataFrame:
    """``(label DOUBLE, features VECTOR)`` from the embedding table."""
    return _dense_rows(spark, sf).drop("vec_id")


def _dense_rows(spark: SparkSession, sf: str) -> DataFrame:
    label = (F.col("label") < 5).cast("double").alias("label")
    return dense.to_vectors(table(spark, sf, "embeddings").select("vec_id", label, F.col("embedding").alias("features")))


def keyed_dense_split(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The two parts below, with ``vec_id``."""
    return random_split(_dense_rows(spark, sf), 0.8, 7, "vec_id")


def dense_split(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    train, test = keyed_dense_split(spark, sf)
    return train.drop("vec_id"), test.drop("vec_id")
