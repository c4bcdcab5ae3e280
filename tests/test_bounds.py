"""What a step may hold or move at once."""

import numpy as np
from pyspark.sql import functions as F

from tonegrid.operators import corpus, segment, vectors

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_segmentation_bounds_its_batches(spark):
    spark.conf.unset(BATCH)
    docs = spark.createDataFrame([(1, "國家更需要"), (1, "國家更需要"), (None, None)], "doc_id long, text string")
    lexicon = spark.createDataFrame([("國家", None), ("需要", None)], "token string, flag string")
    got = segment.segmented(docs, lexicon)
    assert int(spark.conf.get(BATCH)) <= 4 << 20
    assert sorted((r.doc_id or 0, r.tokens) for r in got.collect()) == [(0, []), (1, ["國家", "需要"]), (1, ["國家", "需要"])]


def test_document_pairs_bound_their_batches(spark):
    spark.conf.unset(BATCH)
    docs = spark.createDataFrame([(1, ["a", "b", "a", "b"]), (1, ["a", "b"]), (None, None)], "doc_id long, tokens array<string>")
    got = corpus.document_bigrams(docs).groupBy("doc_id", F.array_join("feature", " ").alias("f")).agg(F.sum("n").alias("n"))
    assert int(spark.conf.get(BATCH)) <= 4 << 20
    assert {(r.doc_id, r.f): r.n for r in got.collect()} == {(1, "a b"): 3, (1, "b a"): 1}
    corpus.words_and_bigrams(docs).collect()


def test_a_block_asks_once_for_each_of_its_words(spark):
    many = ["good"] * 1000 + ["bad", "none", None]
    docs = spark.createDataFrame([(1, many), (1, ["bad"]), (None, None), (2, []), (3, ["none"])], "doc_id long, tokens array<string>")
    table = spark.createDataFrame([("good", [1.0, None]), ("bad", [0.5, 2.0, 9.0]), ("bad", [0.0, 1.0]), ("none", None)], "word string, vec array<float>")
    seen = []
    whole = vectors.summed_in_blocks

    def summed(*args):
        seen.append(args)
        return whole(*args)

    vectors.summed_in_blocks = summed
    try:
        got = vectors.sentence_vectors(docs.coalesce(1), table, 2, 10**9)
    finally:
        vectors.summed_in_blocks = whole
    assert seen and {r.doc_id: r.vec for r in got.collect()} == {1: [1001.0, 6.0], None: [0.0, 0.0], 2: [0.0, 0.0], 3: [0.0, 0.0]}
    small = vectors.sentence_vectors(docs, table, 2)
    assert {r.doc_id: r.vec for r in small.collect()} == {r.doc_id: r.vec for r in got.collect()}
    names = [b for b in docs.coalesce(1).mapInArrow(lambda batches: vectors._word_blocks(batches, ["doc_id"]),
             "block long, keys array<struct<doc_id: long>>, starts binary, cells binary, words array<string>").collect()]
    assert [sorted(b.words) for b in names] == [["bad", "good", "none"]]


def test_banded_search_shuffles_no_pairs(spark):
    rng = np.random.default_rng(1)
    points = rng.standard_normal((300, 8))
    table = spark.createDataFrame([(f"w{i:03}", [float(x) for x in p]) for i, p in enumerate(points)] + [("zero", [0.0] * 8), ("null", None)],
                                  "word string, vec array<double>")
    queries = table.where("word < 'w020'")
    found = vectors.nearest_words_lsh(queries, table, 8, 5, 3, 4)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    unit = points / np.linalg.norm(points, axis=1)[:, None]
    codes = vectors._signs(3, 4, 8, 0)(unit)
    got = {}
    for r in found.collect():
        got.setdefault(r.query, []).append((r["rank"], r.word))
    for q in range(20):
        near = [(-round(float(unit[i] @ unit[q]), 6), f"w{i:03}") for i in range(300) if i != q and (codes[i] == codes[q]).any()]
        assert sorted(got[f"w{q:03}"]) == [(k, w) for k, (_, w) in enumerate(sorted(near)[:5], 1)]
