import random
from functools import reduce
from operator import add

import pytest
from pyspark.sql import functions as F

from tonegrid.operators import evaluate
from tonegrid.plans import dense, trees


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(2)
    rows = []
    for i in range(240):
        v = [rng.gauss(0, 1) for _ in range(6)]
        rows.append((i, float(v[0] + v[1] * v[2] + rng.gauss(0, 0.3) > 0), v))
    return dense.to_vectors(spark.createDataFrame(rows, "vec_id long, label double, features array<double>")).persist()


@pytest.mark.parametrize("name", ["DecisionTree", "RandomForest", "GBT"])
def test_node_tables_say_what_the_models_say(points, name):
    model = dense.fit(name, points, **({"iterations": 8} if name == "GBT" else {}))
    table = trees.node_model(model)
    assert table.depth() == max(t.depth for t in (model.trees if name != "DecisionTree" else [model]))
    own = {r.vec_id: r for r in model.transform(points).collect()}
    mine = table.transform(points.select("vec_id", "features")).collect()
    assert len(mine) == 240
    for r in mine:
        assert r.prediction == own[r.vec_id].prediction
        if name == "GBT":
            assert r.score == pytest.approx(own[r.vec_id].rawPrediction[1], abs=1e-9)
        if name == "RandomForest":
            assert r.score == pytest.approx(own[r.vec_id].probability[1], abs=1e-9)
    assert tuple(trees.agreement(model, points).first()) == (240, 240)


def test_stages_from_the_table(points):
    model = dense.fit("GBT", points, iterations=12, seed=4)
    staged = trees.node_model(model).staged(points.select("vec_id", "label", "features"), [1, 5, 12])
    want = dense.staged_predictions(model, points, [1, 5, 12])
    mine = {(r.vec_id, r.k): (r.prediction, round(r.score, 9)) for r in staged.collect()}
    theirs = {(r.vec_id, r.k): (r.prediction, round(r.margin, 9)) for r in want.collect()}
    assert mine == theirs
    assert evaluate.metrics(staged.select("label", "k", "prediction"), ["k"]).count() == 3


def test_a_single_leaf_and_no_rows(points):
    one = points.withColumn("label", F.lit(1.0)).unionByName(points.limit(1).withColumn("label", F.lit(0.0)))
    stump = dense.tree().setMaxDepth(0).fit(one)
    table = trees.node_model(stump)
    assert table.depth() == 0
    assert table.transform(points.select("vec_id", "features")).where("prediction = 1").count() == 240
    assert table.transform(points.limit(0).select("vec_id", "features")).count() == 0


def test_large_trees_are_not_sent_to_every_task(spark, monkeypatch):
    """Trees of very unequal depth: every task gets some pieces only, and scores are added in the order of the trees."""
    rng, trees_n = random.Random(5), 3
    tables = []
    for t in range(trees_n):
        tables.append([])

        def grow(level, table):
            node = len(table)
            table.append(None)
            if level == 16 or (level > 3 and rng.random() < 0.3):
                p = rng.random()
                table[node] = (-1, -1, -1, None, float(p > 0.5), [1 - p, p])
            else:
                cut = (rng.randrange(4), rng.gauss(0, 1))
                table[node] = (node + 1, -1, *cut, 0.0, [0.5, 0.5])
                grow(level + 1, table)
                right = grow(level + 1, table)
                table[node] = (node + 1, right, *cut, 0.0, [0.5, 0.5])
            return node

        grow(0, tables[-1])
    flat = [(t, i, *n) for t, table in enumerate(tables) for i, n in enumerate(table)]
    assert len(flat) > 1000
    schema = "tree int, node int, left int, right int, feature int, threshold double, value double, shares array<double>"
    nodes = spark.createDataFrame(flat, schema).persist()
    points = [(i, [rng.gauss(0, 1) for _ in range(4)] if i % 3 else [0.5] * 4) for i in range(120)]
    rows = dense.to_vectors(spark.createDataFrame(points, "vec_id long, features array<double>"))

    sent, broadcast = [], F.broadcast
    monkeypatch.setattr(F, "broadcast", lambda df: sent.append(df.count()) or broadcast(df))
    monkeypatch.setattr(trees, "SENT", 40, raising=False)
    model = trees.NodeModel(nodes, trees.SHARES, trees_n)
    found = {r.vec_id: r.score for r in model.transform(rows).collect()}
    assert max(sent) <= 40

    def leaf(table, x):
        n, level = table[0], 0
        while n[0] >= 0:
            n, level = table[n[0] if x[n[2]] <= n[3] else n[1]], level + 1
        return n, level

    plain = lambda x: reduce(add, [leaf(table, x)[0][5][1] for table in tables], 0.0) / trees_n  # sum() rounds in another way
    assert found == {i: plain(x) for i, x in points}
    assert max(leaf(table, x)[1] for table in tables for _, x in points) > 2 * trees.LEVELS

    def depth(table, node=0):
        return 0 if table[node][0] < 0 else 1 + max(depth(table, c) for c in table[node][:2])

    assert model.depth() == max(map(depth, tables))
