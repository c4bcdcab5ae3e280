import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tonegrid.operators import association, counts, skew
from tonegrid.plans.selection import select_features


def pairs(df):
    return {(r.label, r.w1, r.w2): r.n for r in df.collect()}


def test_class_counts_and_totals(docs):
    got = {r.token: (r.n_pos, r.n_neg, r.n) for r in counts.class_word_freq(docs).collect()}
    assert got == {"good": (3, 0, 3), "bad": (0, 3, 3), "day": (1, 1, 2), "film": (1, 1, 2)}
    assert {r.label: r.n for r in counts.class_totals(docs).collect()} == {"pos": 5, "neg": 5, None: 10}


def test_bigrams_cross_documents_and_empty_ones(docs):
    got = pairs(counts.bigram_freq(docs))
    assert {k[1:]: v for k, v in got.items() if k[0] == "pos"} == {
        ("good", "good"): 1, ("good", "day"): 1, ("day", "good"): 1, ("good", "film"): 1,
    }
    assert sum(v for k, v in got.items() if k[0] == "pos") == 5 - 1
    inside = pairs(counts.bigram_freq(docs, cross_docs=False))
    assert ("pos", "day", "good") not in inside and sum(inside.values()) == 3 + 3


def test_word_scores_by_hand(docs):
    got = {r.token: r.score for r in association.word_scores(docs).collect()}
    assert got == {"good": 8.571429, "bad": 8.571429, "day": 0.0, "film": 0.0}
    top = association.best(association.word_scores(docs).withColumnRenamed("token", "feature"), 2)
    assert [r.feature for r in top.orderBy("rank").collect()] == ["bad", "good"]


def test_word_in_every_position_has_no_score_and_sorts_last(spark):
    one = spark.createDataFrame([(0, "pos", ["a", "a"]), (1, "neg", ["a"])], "doc_id long, label string, tokens array<string>")
    scored = association.word_scores(one).withColumnRenamed("token", "feature")
    assert association.best(scored, 5).first().score is None


@pytest.fixture(scope="module")
def skewed(spark):
    """One word and one pair hold more than a third of everything; ids are uneven."""
    rng = random.Random(3)
    rows = []
    for i in range(300):
        words = ["the" if rng.random() < 0.4 else f"w{rng.randint(0, 40)}" for _ in range(rng.randint(0, 12))]
        rows.append((i if i < 250 else i * 10**9, rng.choice(["pos", "pos", "neg"]), words))
    return rows, spark.createDataFrame(rows, "doc_id long, label string, tokens array<string>").repartition(5)


def chained(rows):
    out = {}
    for label in ("pos", "neg"):
        out[label] = [w for _, l, t in sorted(rows) if l == label for w in t]
    return out


def chi2(ii, ix, xi, n):
    io, oi = ix - ii, xi - ii
    oo = n - ii - io - oi
    den = (ii + io) * (ii + oi) * (io + oo) * (oi + oo)
    return round(n * ((ii * oo - io * oi) ** 2 / den), 6) if den else None


def test_bigram_counts_and_scores_on_skewed_data(skewed):
    rows, df = skewed
    want, scores = {}, {}
    for label, seq in chained(rows).items():
        words, found = Counter(seq), Counter(zip(seq, seq[1:]))
        for (a, b), n in found.items():
            want[label, a, b] = n
            scores[label, a, b] = chi2(n, words[a], words[b], len(seq))
    assert pairs(counts.bigram_freq(df)) == want
    got = {(r.label, r.w1, r.w2): r.score for r in association.bigram_scores(df).collect()}
    assert got.keys() == scores.keys()
    assert all(got[k] == pytest.approx(v, abs=2e-6) for k, v in scores.items() if v is not None)


def test_lookup_joins_hot_and_cold_keys_alike(spark, monkeypatch):
    left = spark.createDataFrame([("g", "a", i) for i in range(50)] + [("g", "b", 1), ("g", "zz", 2)], "g string, k string, i int")
    table = spark.createDataFrame([("g", "a", 10), ("g", "b", 20)], "g string, k string, v int")
    for hot in (table.where("k = 'a'"), table.where("false"), table):
        got = Counter((r.k, r.v) for r in skew.lookup(left, table, ["g", "k"], ["v"], hot, F.col("i")).collect())
        assert got == {("a", 10): 50, ("b", 20): 1, ("zz", None): 1}
        inner = skew.lookup(left, table, ["g", "k"], ["v"], hot, F.col("i"), "inner")
        assert inner.count() == 51
        both = skew.split_join(left, table.drop("g"), "k", hot.drop("g"))
        assert Counter((r.k, r.v) for r in both.collect()) == {("a", 10): 50, ("b", 20): 1}


def test_hot_keys_are_bounded(spark):
    table = spark.createDataFrame([(f"k{i}", i * i) for i in range(1, 200)], "k string, n long")
    for slots in (4, 16, 64):
        assert skew.hot_keys(table, slots=slots).count() <= slots


def test_top_n_equals_plain_ranking(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.randint(0, 50), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, s int, i int").repartition(16)
    got = {(r.g, r.s, r.i, r["rank"]) for r in skew.top_n(df, ["g"], [F.desc("s"), F.asc("i")], 100, fan_in=3).collect()}
    want = set()
    for g in "ab":
        ordered = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))[:100]
        want |= {(*r, n + 1) for n, r in enumerate(ordered)}
    assert got == want


def test_pairs_count_once_and_raise_the_total(docs):
    got = {tuple(r.feature): (r.n_pos, r.n_neg, r.n) for r in association.word_bigram_scores(docs).collect()}
    assert got[("good",)] == (3, 0, 3) and got[("good", "good")] == (1, 0, 1)
    score = next(r.score for r in association.word_bigram_scores(docs).collect() if r.feature == ["good"])
    assert score == round(2 * chi2(3, 3, 5 + 4, 10 + 8), 6)


def test_negative_pairs_for_both_classes(docs):
    got = {tuple(r.feature): (r.n_pos, r.n_neg) for r in association.word_bigram_scores(docs, negative_pairs_only=True).collect()}
    assert got[("bad", "film")] == (1, 1) and ("good", "good") not in got


def test_selection_does_not_depend_on_partitioning(skewed):
    _, df = skewed
    first = select_features(df, 30).orderBy("rank").collect()
    assert select_features(df.repartition(1), 30).orderBy("rank").collect() == first
    assert [r["rank"] for r in first] == list(range(1, 31))
    assert all(s.score is None or s.score >= 0 for s in association.word_bigram_scores(df).collect())


def test_a_selection_reads_the_corpus_once(spark, docs):
    """Words, pairs and borders come from one pass: each document's tokens are made once."""
    from pyspark.sql.types import ArrayType, StringType

    made = spark.sparkContext.accumulator(0)

    def split(text):
        made.add(1)
        return text.split(" ") if text else []

    texts = docs.select("doc_id", "label", F.array_join("tokens", " ").alias("t")).repartition(2).checkpoint()
    lazily = texts.select("doc_id", "label", F.udf(split, ArrayType(StringType()))("t").alias("tokens"))
    got = select_features(lazily, 5).select("feature", "rank")
    assert sorted(map(str, got.collect())) == sorted(map(str, select_features(docs, 5).select("feature", "rank").collect()))
    assert made.value == docs.count()


def test_borders_with_repeated_and_empty_documents(spark):
    rows = [(1, "pos", ["a", "b"]), (1, "pos", ["a", "b"]), (2, "pos", []), (3, "pos", None), (4, "pos", ["c"]), (1, "neg", ["x"])]
    df = spark.createDataFrame(rows, "doc_id long, label string, tokens array<string>")
    words, pairs = counts.corpus_counts(df)
    assert sorted(map(tuple, words.collect())) == [("a", 2, 0, 2), ("b", 2, 0, 2), ("c", 1, 0, 1), ("x", 0, 1, 1)]
    assert sorted(map(tuple, pairs.collect())) == [("pos", "a", "b", 2), ("pos", "b", "a", 1), ("pos", "b", "c", 1)]
    assert counts.corpus_counts(df.limit(0))[1].count() == 0


def test_pairs_are_counted_in_one_exchange_and_looked_up_unsorted(spark, docs):
    """Borders are counted with the inner pairs, and neither lookup sorts the pairs; words are sums of pairs."""
    words, pairs = counts.corpus_counts(docs)
    assert "Exchange" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in association.pair_scores(words, pairs)._jdf.queryExecution().executedPlan().toString()
    for cross in (True, False):
        words = counts.corpus_counts(docs, cross)[0]
        assert sorted(map(tuple, words.collect())) == sorted(map(tuple, counts.class_word_freq(docs).collect()))
