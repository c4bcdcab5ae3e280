"""Classifiers on dense document vectors: ``(label DOUBLE, features VECTOR)``."""

from __future__ import annotations

from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassificationModel,
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from ..operators import evaluate
from ..session import scratch_path, shared_dir
from .training import training_rows

GBT_ITERATIONS = 75


def to_vectors(df: DataFrame, column: str = "features") -> DataFrame:
    return df.withColumn(column, array_to_vector(F.col(column).cast("array<double>")))


def logistic() -> LogisticRegression:
    return LogisticRegression(regParam=0.0, fitIntercept=False, maxIter=100, tol=1e-6)


def tree(seed: int = 0) -> DecisionTreeClassifier:
    return DecisionTreeClassifier(impurity="entropy", maxDepth=20, maxBins=20, seed=seed)


def forest(seed: int = 0) -> RandomForestClassifier:
    return RandomForestClassifier(
        numTrees=40, featureSubsetStrategy="auto", impurity="entropy", maxDepth=20, maxBins=20, seed=seed
    )


def boosted(iterations: int = GBT_ITERATIONS, seed: int = 0) -> GBTClassifier:
    """A checkpoint folder, when set, keeps the lineage of long fits short."""
    return GBTClassifier(maxIter=iterations, maxDepth=3, stepSize=0.1, maxBins=32, seed=seed, checkpointInterval=10)


DENSE = {"LogisticRegression": logistic, "DecisionTree": tree, "RandomForest": forest, "GBT": boosted}


def fit(name: str, train: DataFrame, **params):
    shared_dir(train.sparkSession)
    rows, _ = training_rows(train)
    try:
        return DENSE[name](**params).fit(rows)
    finally:
        rows.unpersist()


def leaf_values(model: GBTClassificationModel) -> DataFrame:
    """One row ``t``: for each tree the weighted value of each leaf, leaves numbered left to right.

    Read from the saved form of the model, where a node without children is a leaf and nodes are
    numbered depth first.
    """
    spark = SparkSession.active()
    path = scratch_path(spark, "boosted")
    model.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    leaves = nodes.where("nodeData.leftChild < 0").select(
        F.col("treeID").alias("tree"), F.col("nodeData.id").alias("id"), F.col("nodeData.prediction").alias("v")
    )
    weights = F.array(*[F.lit(float(w)) for w in model.treeWeights])
    per_tree = leaves.groupBy("tree").agg(F.sort_array(F.collect_list(F.struct("id", "v"))).alias("s"))
    per_tree = per_tree.select("tree", F.transform("s.v", lambda v: v * weights[F.col("tree")]).alias("vs"))
    return per_tree.agg(F.sort_array(F.collect_list(F.struct("tree", "vs"))).alias("t")).select("t.vs")


def staged_predictions(model: GBTClassificationModel, df: DataFrame, stages: list[int]) -> DataFrame:
    """What the model's first ``k`` trees predict, for each ``k`` in ``stages``.

    Adds ``k, margin, prediction`` and returns one row per input row and stage. The first k trees
    of a longer fit are the k-iteration fit, so a sweep needs one fit only. Margins are built in
    the row from its leaf numbers and a leaf table of trees x leaves numbers; nothing is shuffled.
    """
    stages = sorted(stages)
    table = leaf_values(model).scalar()
    model = model.copy()
    model.setLeafCol("__leaf")
    leaves = model.transform(df).select(*df.columns, vector_to_array("__leaf").alias("__leaf")).withColumn("__t", table)
    adds = F.transform("__leaf", lambda l, i: F.element_at(F.col("__t")[i], l.cast("int") + 1))
    x = leaves.select(*df.columns, adds.alias("__v"))
    spans = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in zip([0, *stages], stages)])
    part = lambda s: F.aggregate(F.slice("__v", s["a"] + 1, s["b"] - s["a"]), F.lit(0.0), lambda t, v: t + v)
    x = x.withColumn("__p", F.transform(spans, part))
    none = F.struct(F.lit(0.0).alias("m"), F.array().cast("array<double>").alias("ms"))
    run = F.aggregate(
        "__p",
        none,
        lambda acc, v: F.struct((acc["m"] + v).alias("m"), F.concat(acc["ms"], F.array(acc["m"] + v)).alias("ms")),
        lambda acc: acc["ms"],
    )
    named = F.arrays_zip(F.array(*[F.lit(k) for k in stages]).alias("k"), run.alias("margin"))
    out = x.select(*df.columns, F.explode(named).alias("s"))
    return out.select(*df.columns, "s.k", "s.margin", (F.col("s.margin") > 0).cast("double").alias("prediction"))


def iteration_sweep(train: DataFrame, test: DataFrame, stages: list[int], seed: int = 0) -> DataFrame:
    """Metrics after each number of boosting iterations, from one fit."""
    model = fit("GBT", train, iterations=max(stages), seed=seed)
    staged = staged_predictions(model, test.select("label", "features"), stages)
    return evaluate.metrics(staged.select("label", "k", "prediction"), ["k"])
