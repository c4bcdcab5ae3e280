"""The two end-to-end classifiers: selected-word presence, and summed word vectors with boosted trees."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import corpus, evaluate
from ..operators.segment import segmented
from ..operators.split import positional_split
from ..operators.vectors import sentence_vectors
from ..session import GROUP_LIMIT
from ..sources import artefacts
from . import classifiers, dense
from .selection import select_features

DEFAULT_FEATURES = 700
NEIGHBOURS = 10


def text_tokens(
    rows: DataFrame, column: str = "text", stopwords: DataFrame | None = None, lexicon: DataFrame | None = None, **options
) -> DataFrame:
    """Raw text to filtered tokens: split at blanks and marks, or, with a lexicon ``(token, flag)``, segmented.

    Text is lower-cased. ``options`` are those of ``corpus.clean``; with a lexicon, ``flags`` and ``min_length``.
    """
    if lexicon is None:
        return corpus.clean(rows, stopwords, column, **options)
    options = {"flags": text.DROP_FLAGS} | options
    tokens = segmented(rows.withColumn(column, F.lower(column)), lexicon, column, **options)
    return tokens if stopwords is None else corpus.remove_stopwords(tokens, stopwords)


@dataclass
class SentimentModel:
    """Feature selection plus one named classifier."""

    name: str
    k: int
    features: DataFrame
    classifier: object

    @classmethod
    def fit(
        cls,
        docs: DataFrame,
        name: str = "LogisticRegression",
        k: int = DEFAULT_FEATURES,
        vectors: DataFrame | None = None,
        root: str | None = None,
        pairs: int = GROUP_LIMIT,
    ) -> "SentimentModel":
        """Select features on ``(doc_id, label, tokens)`` and train; with ``root``, both are saved there."""
        features = select_features(docs, k, vectors, NEIGHBOURS, pairs)
        if root is not None:
            features = artefacts.save_features(features, root, k)
        model = cls(name, k, features, classifiers.fit(name, docs, features))
        if root is not None:
            model.classifier.save(artefacts.model_path(root, name, k))
        return model

    @classmethod
    def read(cls, spark: SparkSession, root: str, name: str, k: int = DEFAULT_FEATURES) -> "SentimentModel":
        path = artefacts.model_path(root, name, k)
        return cls(name, k, artefacts.load_features(spark, root, k), classifiers.load(spark, path))

    @classmethod
    def load(
        cls,
        spark: SparkSession,
        root: str,
        name: str = "LogisticRegression",
        docs: DataFrame | None = None,
        k: int = DEFAULT_FEATURES,
        vectors: DataFrame | None = None,
        train_share: float = 0.9,
        seed: int = 0,
    ) -> "SentimentModel":
        """The saved model, or one trained on ``train_share`` of each class of ``docs`` and saved."""
        # the metadata is written last, so it marks a complete model
        if artefacts.exists(spark, artefacts.model_path(root, name, k) + "/meta"):
            return cls.read(spark, root, name, k)
        if docs is None:
            raise FileNotFoundError(f"no saved model {name} with k={k} under {root}, and no corpus to train on")
        train = positional_split(docs, train_share, seed).where("part = 'train'").drop("part")
        return cls.fit(train, name, k, vectors, root)

    def predict_tokens(self, docs: DataFrame) -> DataFrame:
        """Label rows that carry ``tokens``, without any token filter."""
        return self.classifier.transform(docs)

    def predict_text(
        self, rows: DataFrame, column: str = "text", stopwords: DataFrame | None = None, lexicon: DataFrame | None = None, **options
    ) -> DataFrame:
        """Label raw text: tokenise and filter, then as above. With a lexicon, unspaced text is segmented by it."""
        return self.predict_tokens(text_tokens(rows, column, stopwords, lexicon, **options))

    def score(self, docs: DataFrame) -> float:
        """Area under the ROC curve of the 0/1 predictions."""
        scored = classifiers.numeric_label(self.predict_tokens(docs))
        return evaluate.auc_hard(scored).first()[0]


@dataclass
class VectorSentimentModel:
    """Boosted trees on dense document vectors; sentences are scored by the sum of their word vectors."""

    model: GBTClassificationModel
    dim: int

    @classmethod
    def fit(cls, rows: DataFrame, iterations: int = dense.GBT_ITERATIONS, seed: int = 0) -> "VectorSentimentModel":
        """``rows``: ``(label DOUBLE, features VECTOR)``."""
        model = dense.fit("GBT", rows, iterations=iterations, seed=seed)
        return cls(model, model.numFeatures)

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    @classmethod
    def load(cls, path: str) -> "VectorSentimentModel":
        model = GBTClassificationModel.load(path)
        return cls(model, model.numFeatures)

    def transform(self, rows: DataFrame) -> DataFrame:
        return self.model.transform(rows)

    def predict(self, docs: DataFrame, vectors: DataFrame, max_words: int | None = None) -> DataFrame:
        """Score ``(…, tokens)`` rows against a ``(word, vec)`` table."""
        summed = sentence_vectors(docs, vectors, self.dim, max_words)
        scored = self.model.transform(dense.to_vectors(summed.withColumnRenamed("vec", "features")))
        return scored.select(*[c for c in docs.columns if c != "tokens"], "probability", "prediction")

    def predict_text(
        self, rows: DataFrame, vectors: DataFrame, column: str = "text", stopwords: DataFrame | None = None,
        lexicon: DataFrame | None = None, **options,
    ) -> DataFrame:
        """Score raw sentences against a ``(word, vec)`` table."""
        return self.predict(text_tokens(rows, column, stopwords, lexicon, **options), vectors)

    def score(self, rows: DataFrame) -> float:
        return evaluate.auc_hard(self.transform(rows)).first()[0]
