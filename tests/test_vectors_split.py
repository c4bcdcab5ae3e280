import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonegrid.operators import split, vectors
from tonegrid.session import POS


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    rows = [(f"w{i:03d}", rng.normal(size=5).astype("float32").tolist()) for i in range(120)]
    rows += [("same1", rows[0][1]), ("same2", rows[0][1]), ("zero", [0.0] * 5)]
    return rows, spark.createDataFrame(rows, "word string, vec array<float>").repartition(7)


@pytest.mark.parametrize("block", [4096, 3])
@pytest.mark.parametrize("part", [1 << 14, 9])
def test_nearest_words_against_brute_force(table, monkeypatch, block, part):
    rows, df = table
    monkeypatch.setattr(vectors, "QUERY_BLOCK", block)
    monkeypatch.setattr(vectors, "PART_WORDS", part)
    queries = [r for r in rows if r[0] in ("w000", "w005", "w017", "same1", "zero")]
    got = vectors.nearest_words(df.where(F.col("word").isin(*[q[0] for q in queries])), df, 10)
    got = {(r["query"], r["rank"]): (r.word, r.cosine) for r in got.collect()}
    want = {}
    for name, q in queries:
        if name == "zero":
            continue
        sims = []
        for word, v in rows:
            if word not in (name, "zero"):
                a, b = np.array(q, float), np.array(v, float)
                sims.append((-round(float(a @ b / math.sqrt(a @ a) / math.sqrt(b @ b)), 6), word))
        for i, (s, word) in enumerate(sorted(sims)[:10]):
            want[name, i + 1] = (word, -s)
    assert got == want
    assert got["w000", 1] == ("same1", 1.0) and got["w000", 2] == ("same2", 1.0)


def test_nearest_words_of_nothing(spark, table):
    _, df = table
    assert vectors.nearest_words(df.limit(0), df).count() == 0 == vectors.nearest_words(df.where("word = 'w000'"), df.limit(0)).count()
    assert vectors.nearest_words(df.where("word = 'zero'"), df).count() == 0


def test_lsh_finds_most_of_the_nearest(table):
    _, df = table
    exact = vectors.nearest_words(df, df, 5)
    near = vectors.recall(vectors.nearest_words_lsh(df, df, 5, 5, bits=3, bands=24), exact).first()
    far = vectors.recall(vectors.nearest_words_lsh(df, df, 5, 5, bits=12, bands=1), exact).first()
    assert near.n_queries == 122 and near.n_exact == 610 and near.recall >= 0.95 > 0.5 > far.recall > 0
    both = vectors.nearest_words_lsh(df, df, 5, 5, bits=1, bands=16).select("query", "word", "cosine", "rank")
    assert sorted(map(tuple, both.collect())) == sorted((r["query"], r.word, r.cosine, r["rank"]) for r in exact.collect())


def test_pair_queries_by_hand(spark):
    rows = [("a", [2.0, 0.0]), ("b", [0.0, 5.0]), ("c", [1.0, 1.1]), ("d", [1.0, -1.0]), ("e", [3.0, 3.0]), ("z", [0.0, 0.0])]
    df = spark.createDataFrame(rows, "word string, vec array<double>")
    features = spark.createDataFrame([(["a", "b"], 1), (["d"], 2), (["a", "z"], 3), (["a", "none"], 4)], "feature array<string>, rank int")
    queries = {r.word: (r.vec, r.excluded) for r in vectors.pair_queries(features.where(F.size("feature") == 2), df).collect()}
    assert queries == {"a b": ([0.5, 0.5], ["a", "b"])}
    got = {tuple(r.feature): (r["rank"], r.source) for r in vectors.expand_features(features, df, 1, pairs=True).collect()}
    assert got == {("a", "b"): (1, "selected"), ("e",): (1, "expanded"), ("d",): (2, "selected"), ("a",): (2, "expanded"),
                   ("a", "z"): (3, "selected"), ("a", "none"): (4, "selected")}


def test_sentence_vectors_both_ways(spark, docs):
    rows = [("good", [1.0, 0.5]), ("bad", [-1.0, 0.25])]
    df = spark.createDataFrame(rows, "word string, vec array<float>")
    want = {0: [2.0, 1.0], 1: [0.0, 0.0], 2: [1.0, 0.5], 3: [-1.0, 0.25], 4: [-2.0, 0.5]}
    for bound in (2, 10**9, None):
        got = vectors.sentence_vectors(docs.select("doc_id", "tokens"), df, 2, bound)
        assert {r.doc_id: r.vec for r in got.collect()} == want


def test_expansion_keeps_best_rank(spark, table):
    _, df = table
    features = spark.createDataFrame([(["w000"], 1), (["w001"], 2), (["w000", "w001"], 3), (["unknown"], 4)], "feature array<string>, rank int")
    got = {tuple(r.feature): (r["rank"], r.source) for r in vectors.expand_features(features, df, 2).collect()}
    assert got["same1",] == (1, "expanded") and got["same2",] == (1, "expanded")
    assert got["w000", "w001"] == (3, "selected") and got["unknown",] == (4, "selected")
    assert len(got) <= 4 + 2 * 2


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(1003).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 7 == 0, "neg").otherwise(POS).alias("label"))
    return df.repartition(6)


@pytest.mark.parametrize("digits", [1, 3])
def test_positional_split_is_exact(rows, digits):
    got = {r.doc_id: (r.label, r.part) for r in split.positional_split(rows, 0.9, 42, digits=digits).collect()}
    assert len(got) == 1003
    for label in ("pos", "neg"):
        ids = sorted((hashlib.md5(f"{i}-42".encode()).hexdigest(), i) for i, (l, _) in got.items() if l == label)
        cut = math.floor(0.9 * len(ids))
        assert [got[i][1] for _, i in ids] == ["train"] * cut + ["test"] * (len(ids) - cut)
    again = split.positional_split(rows.repartition(3), 0.9, 42)
    assert {r.doc_id: (r.label, r.part) for r in again.collect()} == got


def test_shuffle_is_a_seeded_permutation(rows):
    one = {r.doc_id: r.position for r in split.shuffled(rows, 1).collect()}
    assert sorted(one.values()) == list(range(1, 1004))
    order = sorted(one, key=lambda i: hashlib.md5(f"{i}-1".encode()).hexdigest())
    assert [one[i] for i in order] == list(range(1, 1004))
    assert {r.doc_id: r.position for r in split.shuffled(rows, 2).collect()} != one


def test_random_and_hash_split_cover_all_rows(rows):
    train, test = split.random_split(rows, 0.8, 3)
    ids = Counter(r.doc_id for r in train.union(test).collect())
    assert len(ids) == 1003 and set(ids.values()) == {1}
    parts = Counter(r.part for r in split.hash_split(rows, 0.8, 3).collect())
    assert sum(parts.values()) == 1003 and abs(parts["train"] / 1003 - 0.8) < 0.05


def test_single_document_class(spark):
    df = spark.createDataFrame([(1, "pos"), (2, "neg"), (3, "neg")], "doc_id long, label string")
    got = Counter((r.label, r.part) for r in split.positional_split(df).collect())
    assert got == {("pos", "test"): 1, ("neg", "train"): 1, ("neg", "test"): 1}


def test_expansion_computes_its_features_once(spark):
    made = spark.sparkContext.accumulator(0)

    def rank(i):
        made.add(1)
        return i

    table = spark.createDataFrame([(w, [float(i), 1.0]) for i, w in enumerate("abcdef")], "word string, vec array<double>")
    rows = spark.createDataFrame([(["a"], 1), (["b", "c"], 2)], "feature array<string>, i int")
    features = rows.select("feature", F.udf(rank, "int")("i").alias("rank"))
    got = vectors.expand_features(features, table, 2, pairs=True)
    assert {tuple(r.feature) for r in got.where("source = 'selected'").collect()} == {("a",), ("b", "c")}
    assert made.value == 2
