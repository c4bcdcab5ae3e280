"""Naive Bayes on word presence as joins and aggregates.

A model is a table ``(feature, n_pos, n_neg)`` of documents per class holding each feature, plus a
few sums. The table is distributed like the data, so the vocabulary has no size limit.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import NEG, POS, materialize
from .corpus import project
from .presence import BROADCAST_ROWS, weight_sums

MULTINOMIAL, BERNOULLI = "multinomial", "bernoulli"


@dataclass
class NaiveBayesTable:
    kind: str
    counts: DataFrame  # feature, n_pos, n_neg
    docs_pos: int
    docs_neg: int

    def __post_init__(self):
        p, q = F.col("n_pos") + 1.0, F.col("n_neg") + 1.0
        if self.kind == MULTINOMIAL:
            total = [F.count("*"), F.sum("n_pos"), F.sum("n_neg")]
            size, pos, neg = (v or 0 for v in self.counts.agg(*total).first())
            self._w = F.log(p / float(pos + size)), F.log(q / float(neg + size))
            absent = 0.0, 0.0
        else:
            p, q = p / (self.docs_pos + 2.0), q / (self.docs_neg + 2.0)
            self._w = F.log(p / (1.0 - p)), F.log(q / (1.0 - q))
            total = [F.count("*"), F.sum(F.log(1.0 - p)), F.sum(F.log(1.0 - q))]
            size, *absent = (v or 0.0 for v in self.counts.agg(*total).first())
        self.size = size
        docs = self.docs_pos + self.docs_neg
        prior = (log(n / docs) if n else float("-inf") for n in (self.docs_pos, self.docs_neg))
        # score of a document without any feature, per class
        self.bias = tuple(a + b for a, b in zip(prior, absent))

    def weights(self, counts: DataFrame | None = None) -> DataFrame:
        """``(feature, w_pos, w_neg)``: what a present word adds to each class's score. Pairs are left out."""
        c = (self.counts if counts is None else counts).where(F.size("feature") == 1)
        return c.select(F.col("feature")[0].alias("feature"), self._w[0].alias("w_pos"), self._w[1].alias("w_neg"))

    def scores(self, docs: DataFrame) -> DataFrame:
        """The columns of ``docs`` with ``s_pos, s_neg`` in place of ``tokens``, for documents without
        features too. Those columns must identify the row.

        The joins are those of ``presence.weight_sums``.
        """
        keys = [c for c in docs.columns if c != "tokens"]
        sums = weight_sums(docs, self.weights(), ["w_pos", "w_neg"], self.size, BROADCAST_ROWS)
        return sums.select(
            *keys,
            (F.coalesce("w_pos", F.lit(0.0)) + self.bias[0]).alias("s_pos"),
            (F.coalesce("w_neg", F.lit(0.0)) + self.bias[1]).alias("s_neg"),
        )

    def transform(self, docs: DataFrame) -> DataFrame:
        """Scores plus ``prediction`` (1.0 positive); equal scores go to the negative class."""
        return self.scores(docs).withColumn("prediction", (F.col("s_pos") > F.col("s_neg")).cast("double"))


def presence_counts(docs: DataFrame, features: DataFrame | None = None) -> DataFrame:
    """Documents per class that hold each feature; all words when no selection is given."""
    if features is None:
        rows = docs.select("label", F.explode(F.array_distinct("tokens")).alias("w")).select("label", F.array("w").alias("feature"))
    else:
        rows = project(docs.select("label", "tokens"), features)
    return rows.groupBy("feature").agg(
        F.count_if(F.col("label") == POS).alias("n_pos"), F.count_if(F.col("label") == NEG).alias("n_neg")
    )


def class_sizes(docs: DataFrame) -> tuple[int, int]:
    """Documents per class (pos, neg)."""
    row = docs.agg(F.count_if(F.col("label") == POS), F.count_if(F.col("label") == NEG)).first()
    return row[0], row[1]


def fit(docs: DataFrame, features: DataFrame | None = None, kind: str = MULTINOMIAL) -> NaiveBayesTable:
    """Count features per class, smoothing by one; features absent from training get no weight.

    The count table is written to the shared folder, so scoring does not count again.
    """
    counts = materialize(presence_counts(docs, features))
    return NaiveBayesTable(kind, counts, *class_sizes(docs))
