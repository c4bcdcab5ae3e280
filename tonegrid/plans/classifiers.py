"""Classifiers by name, behind one fit / transform / save / load shape.

``fit(name, docs, features)`` takes ``(doc_id, label, tokens)`` and returns a model whose
``transform(docs)`` keeps every column but ``tokens`` and adds ``prediction`` (1.0 positive).
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LinearSVC, LinearSVCModel, LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import token_rows
from ..operators import naive_bayes as nb
from ..operators.skew import within
from ..operators.vectors import BROADCAST_CELLS, drawn_sums, sentence_vectors
from ..session import POS, materialize
from . import linear
from .training import training_rows

# A selection of at most this many words is fitted by Spark ML, which keeps one coefficient per word on the driver; a larger
# one, and all words of a corpus, by the table form.
MAX_VOCABULARY = 1 << 20

# Stopping tolerances customary for linear and for kernel support vector machines.
LINEAR_TOLERANCE = 1e-4
KERNEL_TOLERANCE = 1e-3

# A table fit ends when the gradient has this share of its first length.
SLOPE = 1e-3
# Or when a step improves the loss by less than this share.
GAIN = 1e-5

RANDOM_FEATURES = 256
NU = 0.5
NU_GRID = (1e-4, 1e-3, 1e-2, 1e-1)


def numeric_label(docs: DataFrame) -> DataFrame:
    return docs.withColumn("label", (F.col("label") == POS).cast("double"))


def selected_words(features: DataFrame) -> DataFrame:
    """``(word, rank)`` of the single words of a selection."""
    return features.where(F.size("feature") == 1).select(F.col("feature")[0].alias("word"), "rank")


def vocabulary(features: DataFrame) -> list[str]:
    """Selected single words by rank. The caller has made sure that the selection is small."""
    return [r.word for r in sorted(selected_words(features).collect(), key=lambda r: (r["rank"], r.word))]


def vectorizer(words: list[str]) -> CountVectorizerModel:
    """Binary presence vectors; unknown words are ignored, an empty document is a zero vector."""
    return CountVectorizerModel.from_vocabulary(words or [""], inputCol="tokens", outputCol="features", binary=True)


def _write_meta(spark: SparkSession, path: str, meta: dict) -> None:
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_meta(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/meta").first().value)


@dataclass
class PresenceModel:
    """Vectoriser plus a Spark ML classifier."""

    pipeline: PipelineModel

    def transform(self, docs: DataFrame) -> DataFrame:
        scored = self.pipeline.transform(docs)
        extra = [c for c in ("probability", "rawPrediction") if c in scored.columns]
        return scored.select(*[c for c in docs.columns if c != "tokens"], *extra, "prediction")

    def save(self, path: str) -> None:
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        _write_meta(SparkSession.active(), f"{path}/meta", {"shape": "presence"})


_P1, _P2, _P3, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def _turned(h: np.ndarray, bits: int) -> np.ndarray:
    return (h << np.uint64(bits)) | (h >> np.uint64(64 - bits))


def hashed_int(value, code: np.ndarray) -> np.ndarray:
    """``xxhash64`` of Spark for an INT from 0 after the values that gave ``code``."""
    h = (code + (_P5 + np.uint64(4))) ^ (np.atleast_1d(value).astype(np.uint64) * _P1)
    return _mixed(_turned(h, 23) * _P2 + _P3)


def hashed_letter(letter: str, code: np.ndarray) -> np.ndarray:
    """The same for a STRING of one byte."""
    h = (code + (_P5 + np.uint64(1))) ^ (np.array([ord(letter)], np.uint64) * _P5)
    return _mixed(_turned(h, 11) * _P1)


def gaussian_columns(codes: np.ndarray, low: int, high: int, seed: int) -> np.ndarray:
    """Numbers ``low`` to ``high`` of the Gaussian vectors of words with these ``xxhash64`` codes, as in ``FourierModel.gaussians``."""
    first = hashed_int(np.arange(low, high), codes.astype(np.int64).view(np.uint64)[:, None])
    draws = (hashed_int(seed & 0xFFFFFFFF, hashed_letter(letter, first)) & np.uint64((1 << 52) - 1) for letter in "ra")
    radius, angle = ((d.astype(np.float64) + 0.5) / float(1 << 52) for d in draws)
    return np.sqrt(-2.0 * np.log(radius)) * np.cos(2.0 * np.pi * angle)


@dataclass
class FourierModel:
    """Linear SVM on random Fourier features: approximates the Gaussian-kernel SVM.

    Rahimi and Recht (2007): ``sqrt(2/D) cos(w.x + b)`` with Gaussian ``w``. For presence features
    ``w.x`` is a sum of one Gaussian vector per word, so it is a sentence-vector sum.
    """

    words: DataFrame  # word
    size: int
    dim: int
    gamma: float
    seed: int
    linear: LinearSVCModel | None = None

    def _uniform(self, *parts: Column) -> Column:
        h = F.xxhash64(*parts, F.lit(self.seed))
        return (F.pmod(h, F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)

    def gaussians(self) -> DataFrame:
        scale = (2.0 * self.gamma) ** 0.5
        draw = lambda j: (
            F.sqrt(-2.0 * F.log(self._uniform(F.col("word"), j, F.lit("r"))))
            * F.cos(2.0 * F.pi() * self._uniform(F.col("word"), j, F.lit("a")))
            * scale
        )
        return self.words.select("word", F.transform(F.sequence(F.lit(0), F.lit(self.dim - 1)), draw).alias("vec"))

    def features(self, docs: DataFrame) -> DataFrame:
        present = docs.withColumn("tokens", F.array_distinct("tokens"))
        if self.size * self.dim <= BROADCAST_CELLS:
            sums = sentence_vectors(present, self.gaussians(), self.dim, self.size)
        else:  # the same numbers, drawn where they are added up
            scale, seed = (2.0 * self.gamma) ** 0.5, self.seed
            draw = lambda codes, low, high: gaussian_columns(codes, low, high, seed) * scale
            sums = drawn_sums(present, self.words.select("word", F.xxhash64("word").alias("code")), self.dim, draw)
        shift = lambda j: 2.0 * F.pi() * self._uniform(j, F.lit("b"))
        mapped = F.transform("vec", lambda v, j: F.cos(v + shift(j)) * ((2.0 / self.dim) ** 0.5))
        return sums.select(*[c for c in sums.columns if c != "vec"], array_to_vector(mapped).alias("features"))

    def transform(self, docs: DataFrame) -> DataFrame:
        return self.scored(self.features(docs))

    def scored(self, mapped: DataFrame) -> DataFrame:
        """The same from what ``features`` gave."""
        kept = [c for c in mapped.columns if c != "features"]
        return self.linear.transform(mapped).select(*kept, "rawPrediction", "prediction")

    def save(self, path: str) -> None:
        self.words.write.mode("overwrite").parquet(f"{path}/words")
        self.linear.write().overwrite().save(f"{path}/linear")
        meta = {"shape": "fourier", "size": self.size, "dim": self.dim, "gamma": self.gamma, "seed": self.seed}
        _write_meta(self.words.sparkSession, f"{path}/meta", meta)


@dataclass
class NaiveBayesModel:
    table: nb.NaiveBayesTable

    def transform(self, docs: DataFrame) -> DataFrame:
        return self.table.transform(docs)

    def save(self, path: str) -> None:
        t = self.table
        t.counts.write.mode("overwrite").parquet(f"{path}/counts")
        meta = {"shape": "naive_bayes", "kind": t.kind, "sizes": [t.docs_pos, t.docs_neg]}
        _write_meta(t.counts.sparkSession, f"{path}/meta", meta)


@dataclass
class TableModel:
    """A linear model over a word table, with the meta data of its saved form."""

    model: linear.TableLinearModel

    def transform(self, docs: DataFrame) -> DataFrame:
        return self.model.transform(docs)

    def save(self, path: str) -> None:
        m = self.model
        m.weights.write.mode("overwrite").parquet(f"{path}/weights")
        _write_meta(m.weights.sparkSession, f"{path}/meta", {"shape": "table", "bias": m.bias, "size": m.size, "report": m.report})


def load(spark: SparkSession, path: str):
    """Read any saved classifier."""
    meta = read_meta(spark, path)
    if meta["shape"] == "table":
        return TableModel(linear.TableLinearModel(spark.read.parquet(f"{path}/weights"), meta["bias"], meta["size"], meta["report"]))
    if meta["shape"] == "presence":
        return PresenceModel(PipelineModel.load(f"{path}/pipeline"))
    if meta["shape"] == "fourier":
        words = spark.read.parquet(f"{path}/words")
        fitted = LinearSVCModel.load(f"{path}/linear")
        return FourierModel(words, meta["size"], meta["dim"], meta["gamma"], meta["seed"], fitted)
    counts = spark.read.parquet(f"{path}/counts")
    return NaiveBayesModel(nb.NaiveBayesTable(meta["kind"], counts, *meta["sizes"]))


def _fit_naive_bayes(kind):
    def fit(docs: DataFrame, features: DataFrame | None) -> NaiveBayesModel:
        return NaiveBayesModel(nb.fit(docs, features, kind))

    return fit


def fit_presence(estimator, docs: DataFrame, words: list[str]) -> PresenceModel:
    count = vectorizer(words)
    rows, n = training_rows(count.transform(numeric_label(docs)))
    try:
        model = estimator(n).fit(rows)
    finally:
        rows.unpersist()
    return PresenceModel(PipelineModel(stages=[count, model]))


def logistic(n: int) -> LogisticRegression:
    return LogisticRegression(regParam=1.0 / max(n, 1), elasticNetParam=0.0, standardization=False, maxIter=100)


def linear_svm(n: int) -> LinearSVC:
    return LinearSVC(regParam=1.0 / max(n, 1), standardization=False, maxIter=100, tol=LINEAR_TOLERANCE)


def _fit_linear(estimator, loss: str):
    def fit(docs: DataFrame, features: DataFrame | None) -> PresenceModel | TableModel:
        if features is not None and within(selected_words(features), MAX_VOCABULARY):
            return fit_presence(estimator, docs, vocabulary(features))
        words = None if features is None else selected_words(features).select("word")
        return TableModel(linear.fit_linear(docs, words, loss, tolerance=SLOPE, gain=GAIN))

    return fit


def fourier(docs: DataFrame, features: DataFrame | None, dim: int = RANDOM_FEATURES, seed: int = 0) -> FourierModel:
    """The map to random features that the kernel models of these documents share, without a fit."""
    if features is None:
        words = token_rows(docs).select(F.col("token").alias("word")).distinct()
    else:
        words = features.where(F.size("feature") == 1).select(F.col("feature")[0].alias("word"))
    words = materialize(words)
    size = words.count()
    return FourierModel(words, size, dim, 1.0 / max(size, 1), seed)


def _mapped(docs: DataFrame, features: DataFrame | None, dim: int, seed: int, mapped) -> tuple[FourierModel, DataFrame]:
    """A model to be fitted, and the rows ``(label, features)`` for it; those of ``mapped`` if a caller has them stored."""
    if mapped is not None:
        return replace(mapped[0]), numeric_label(mapped[1])
    model = fourier(docs, features, dim, seed)
    return model, model.features(numeric_label(docs))


def fit_kernel_svm(docs: DataFrame, features: DataFrame | None, dim: int = RANDOM_FEATURES, seed: int = 0, mapped=None):
    model, rows = _mapped(docs, features, dim, seed, mapped)
    rows, n = training_rows(rows)
    try:
        model.linear = LinearSVC(regParam=1.0 / max(n, 1), standardization=False, maxIter=100, tol=KERNEL_TOLERANCE).fit(rows)
    finally:
        rows.unpersist()
    return model


def fit_nu_svm(
    docs: DataFrame, features: DataFrame | None, dim: int = RANDOM_FEATURES, seed: int = 0, nu: float = NU, grid=NU_GRID, mapped=None
):
    """Of a grid of penalties, the fit whose share of margin violations is nearest to ``nu``.

    Schoelkopf et al. (2000): nu bounds the share of margin errors from above and that of support
    vectors from below, and both converge to it.
    """
    from pyspark.ml.functions import vector_to_array

    model, rows = _mapped(docs, features, dim, seed, mapped)
    rows, _ = training_rows(rows)
    try:
        found = []
        for penalty in grid:
            fitted = LinearSVC(regParam=penalty, standardization=False, maxIter=100, tol=KERNEL_TOLERANCE).fit(rows)
            signed = (2.0 * F.col("label") - 1.0) * vector_to_array("rawPrediction")[1]
            share = fitted.transform(rows).agg(F.avg((signed < 1.0).cast("double"))).first()[0]
            found.append((abs((share or 0.0) - nu), penalty, fitted))
        model.linear = min(found, key=lambda f: f[:2])[2]
    finally:
        rows.unpersist()
    return model


# Factories: every call fits anew.
CLASSIFIERS = {
    "SVC": fit_kernel_svm,
    "LinearSVC": _fit_linear(linear_svm, "hinge"),
    "NuSVC": fit_nu_svm,
    "MultinomialNB": _fit_naive_bayes(nb.MULTINOMIAL),
    "BernoulliNB": _fit_naive_bayes(nb.BERNOULLI),
    "LogisticRegression": _fit_linear(logistic, "logistic"),
}

# Models over the same random features.
KERNELS = {"SVC": fit_kernel_svm, "NuSVC": fit_nu_svm}


def fit(name: str, docs: DataFrame, features: DataFrame | None = None):
    """Train the named classifier on the selected features, or on all words."""
    return CLASSIFIERS[name](docs, features)
