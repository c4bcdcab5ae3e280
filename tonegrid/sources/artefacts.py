"""Saved feature sets, vocabularies and models, and load-or-build."""

from __future__ import annotations

from collections.abc import Callable
from typing import TypeVar

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

A = TypeVar("A")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a finished output lies at ``path``. Only a missing path counts as absent."""
    try:
        spark.read.text(f"{path.rstrip('/')}/_SUCCESS")
        return True
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise


def features_path(root: str, k: int) -> str:
    return f"{root.rstrip('/')}/features/k={k}"


def model_path(root: str, name: str, k: int) -> str:
    return f"{root.rstrip('/')}/models/name={name}/k={k}"


def save_features(features: DataFrame, root: str, k: int) -> DataFrame:
    """Write a selection and return it as read back, so later work does not recompute it."""
    path = features_path(root, k)
    features.write.mode("overwrite").parquet(path)
    return features.sparkSession.read.parquet(path)


def load_features(spark: SparkSession, root: str, k: int) -> DataFrame:
    return spark.read.parquet(features_path(root, k))


def load_or_build(spark: SparkSession, path: str, load: Callable[[str], A], build: Callable[[], A], save: Callable[[A, str], None]) -> A:
    """Load a finished artefact; build and save it when there is none. Other errors surface."""
    if exists(spark, path):
        return load(path)
    made = build()
    save(made, path)
    return made
