"""Tree models as node tables, scored by joins: a row walks down all trees at once, one join for several levels."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.ml.classification import (
    DecisionTreeClassificationModel,
    GBTClassificationModel,
    RandomForestClassificationModel,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import delete, materialize, scratch_path, union_all

#: How the trees of a kind decide together.
LEAF, SHARES, MARGIN = "leaf", "shares", "margin"
KINDS = {DecisionTreeClassificationModel: LEAF, RandomForestClassificationModel: SHARES, GBTClassificationModel: MARGIN}


#: Levels a row goes down in one join. Pieces of trees, of fewer than 2**LEVELS nodes, that one join may send to every task.
LEVELS, SENT = 5, 2048


@dataclass
class NodeModel:
    """``nodes`` (tree, node, left, right, feature, threshold, value, shares): a leaf has no children (-1), a root is node 0.

    ``value`` is a leaf's prediction, times its tree's weight for boosted trees; ``shares`` are its class shares.
    """

    nodes: DataFrame
    kind: str
    trees: int

    @cached_property
    def places(self) -> DataFrame:
        """``(tree, node, level, code)``: a root has level 0 and code 1, the children of code ``c`` have ``2c`` and ``2c + 1``.

        A node knows one above it, at first its parent, and the way from there. Joining the table with itself doubles the
        distance until all have reached their root: one join for twice the depth, none of them a broadcast.
        """
        turn = lambda side, bit: F.struct(F.col(side).alias("node"), F.lit(bit).cast("long").alias("way"))
        x = self.nodes.where("left >= 0").select("tree", F.col("node").alias("up"), F.inline(F.array(turn("left", 0), turn("right", 1))))
        x = materialize(x.withColumn("level", F.lit(1)))
        while not x.where("up <> 0").isEmpty():
            above = x.select("tree", F.col("node").alias("up"), *[F.col(c).alias(f"__{c}") for c in ("up", "way", "level")])
            moved = x.where("up <> 0").join(above.hint("shuffle_hash"), ["tree", "up"])
            way = F.call_function("shiftleft", "__way", "level") + F.col("way")
            moved = moved.select("tree", F.col("__up").alias("up"), "node", way.alias("way"), (F.col("level") + F.col("__level")).alias("level"))
            x = materialize(union_all(x.where("up = 0"), moved))
        code = F.call_function("shiftleft", F.lit(1).cast("long"), "level") + F.col("way")
        roots = self.nodes.where("node = 0").select("tree", "node", F.lit(0).alias("level"), F.lit(1).cast("long").alias("code"))
        return union_all(roots, x.select("tree", "node", "level", code.alias("code")))

    @cached_property
    def pieces(self) -> DataFrame:
        """``(tree, step, top, at)``: trees cut at every ``LEVELS``-th level, each piece under the code of its top node.

        ``at`` holds the nodes by their place in the piece: 1 is the top, and below ``p`` lie ``2p`` and ``2p + 1``.
        """
        down = F.col("level") % LEVELS
        top = F.call_function("shiftright", "code", down)
        place = F.col("code") - F.call_function("shiftleft", top - 1, down)
        node = F.struct((F.col("left") < 0).alias("leaf"), "feature", "threshold", "value", "shares")
        x = self.nodes.join(self.places.hint("shuffle_hash"), ["tree", "node"])
        x = x.select("tree", ((F.col("level") - down) / LEVELS).cast("int").alias("step"), top.alias("top"), F.struct(place.cast("int"), node).alias("n"))
        x = x.groupBy("tree", "step", "top").agg(F.map_from_entries(F.collect_list("n")).alias("m"))
        at = F.transform(F.sequence(F.lit(0), F.lit(2**LEVELS - 1)), lambda p: F.try_element_at("m", p))
        return materialize(x.select("tree", "step", "top", at.alias("at")))

    @cached_property
    def steps(self) -> list[int]:
        """The number of pieces of each step, from the roots down."""
        return [r["n"] for r in self.pieces.groupBy("step").agg(F.count("*").alias("n")).orderBy("step").collect()]

    def leaves(self, rows: DataFrame) -> DataFrame:
        """One row per row and tree: the columns of ``rows`` but ``features``, ``tree``, ``value``, ``shares``.

        Every step is one join on (tree, top). Few pieces are broadcast, as the upper steps are whatever the size of the
        trees; many meet the rows in a shuffle, where rows that have their leaf travel without features, dealt out evenly.
        """
        kept = [c for c in rows.columns if c != "features"]
        x = rows.select(*kept, vector_to_array("features").alias("__x"), F.explode(F.sequence(F.lit(0), F.lit(self.trees - 1))).alias("tree"))
        x = x.select("*", F.lit(1).cast("long").alias("__top"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("array<double>").alias("shares"))

        def walk(p, _):
            node = F.get("__at", p)
            left = F.get("__x", node["feature"]) <= node["threshold"]
            return F.when(node["leaf"], p).when(left, 2 * p).otherwise(2 * p + 1)

        node, size = F.get("__at", F.col("__p")), 2**LEVELS
        moves = F.col("__at").isNotNull()
        ends = moves & (F.col("__p") < size)
        away = -1 - F.pmod(F.xxhash64(*kept, "tree"), F.lit(1 << 31))  # no piece has it
        top = F.when(ends, away).when(moves, F.col("__top") * size + F.col("__p") - size).otherwise(F.col("__top"))
        for step, n in enumerate(self.steps):
            part = self.pieces.where(F.col("step") == step).select("tree", F.col("top").alias("__top"), F.col("at").alias("__at"))
            x = x.join(F.broadcast(part) if n <= SENT else part.hint("shuffle_hash"), ["tree", "__top"], "left")
            x = x.withColumn("__p", F.aggregate(F.sequence(F.lit(1), F.lit(LEVELS)), F.lit(1), walk))
            x = x.select(
                *kept,
                F.when(~ends, F.col("__x")).alias("__x"),
                "tree",
                top.alias("__top"),
                *[F.when(ends, node[c]).otherwise(F.col(c)).alias(c) for c in ("value", "shares")],
            )
        return x.select(*kept, "tree", "value", "shares")

    def depth(self) -> int:
        """Levels from the roots down to the deepest leaf."""
        return self.places.agg(F.max("level")).first()[0]

    def transform(self, rows: DataFrame) -> DataFrame:
        """The columns of ``rows`` but ``features``, which must identify the row, plus ``score`` and ``prediction``.

        ``score`` is the leaf's prediction, the share of the positive class, or the margin.
        """
        kept = [c for c in rows.columns if c != "features"]
        shares = [F.get("shares", F.lit(i)).alias(c) for i, c in enumerate(("neg", "pos"))]
        found = self.leaves(rows).select(*kept, F.struct("tree", *(shares if self.kind == SHARES else ["value"])).alias("__leaf"))
        found = found.groupBy(*kept).agg(F.sort_array(F.collect_list("__leaf")).alias("__leaves"))
        # added tree by tree, as the models do: in the order of arrival, rounding could turn a tie
        total = lambda c: F.aggregate("__leaves", F.lit(0.0), lambda s, leaf: s + leaf[c])
        if self.kind == SHARES:
            out = found.select(*kept, total("neg").alias("__neg"), total("pos").alias("__pos"))
            said = (F.col("__pos") > F.col("__neg")).cast("double")
            return out.select(*kept, (F.col("__pos") / self.trees).alias("score"), said.alias("prediction"))
        out = found.select(*kept, total("value").alias("score"))
        return out.withColumn("prediction", (F.col("score") > (0.0 if self.kind == MARGIN else 0.5)).cast("double"))

    def staged(self, rows: DataFrame, stages: list[int]) -> DataFrame:
        """What the first ``k`` boosted trees say, for each ``k`` of ``stages``: one row per row and stage, with ``k, score, prediction``."""
        kept = [c for c in rows.columns if c != "features"]
        sums = [F.sum(F.when(F.col("tree") < k, F.col("value"))).alias(f"__{k}") for k in stages]
        each = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"__{k}").alias("score")) for k in stages])
        out = self.leaves(rows).groupBy(*kept).agg(*sums).select(*kept, F.inline(each))
        return out.withColumn("prediction", (F.col("score") > 0).cast("double"))


def node_model(model) -> NodeModel:
    """The node table of a fitted Spark ML tree, forest or boosted model, read from its saved form."""
    kind = KINDS[type(model)]
    spark = SparkSession.active()
    path = scratch_path(spark, "trees")
    model.write().overwrite().save(path)
    data = spark.read.parquet(f"{path}/data")
    if "nodeData" in data.columns:
        data = data.select(F.col("treeID").alias("tree"), "nodeData.*")
    else:
        data = data.select(F.lit(0).alias("tree"), "*")
    stats = F.col("impurityStats")
    total = F.aggregate(stats, F.lit(0.0), lambda s, x: s + x)
    weights = F.array(*[F.lit(float(w)) for w in (model.treeWeights if kind == MARGIN else [1.0])])
    value = F.col("prediction") * (F.get(weights, F.col("tree")) if kind == MARGIN else F.lit(1.0))
    nodes = data.select(
        "tree",
        F.col("id").alias("node"),
        F.col("leftChild").alias("left"),
        F.col("rightChild").alias("right"),
        F.col("split.featureIndex").alias("feature"),
        F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
        value.alias("value"),
        F.transform(stats, lambda x: x / total).alias("shares"),
    )
    nodes = materialize(nodes)
    delete(spark, path)
    return NodeModel(nodes, kind, 1 if kind == LEAF else model.getNumTrees)


def agreement(model, rows: DataFrame, key: str = "vec_id") -> DataFrame:
    """``(n, same)``: rows on which the node table and the model's own ``transform`` say the same."""
    mine = node_model(model).transform(rows.select(key, "features")).select(key, F.col("prediction").alias("__p"))
    own = model.transform(rows.select(key, "features")).select(key, "prediction")
    return own.join(mine, key, "left").agg(F.count("*").alias("n"), F.count_if(F.col("__p") == F.col("prediction")).alias("same"))
