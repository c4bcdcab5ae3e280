import math
import random

import numpy as np
import pytest
from pyspark.ml.classification import NaiveBayes
from pyspark.sql import functions as F

from tonegrid.operators import corpus, evaluate
from tonegrid.operators import naive_bayes as nb
from tonegrid.plans import classifiers, dense, sweeps
from tonegrid.plans.sentiment import SentimentModel, VectorSentimentModel
from tonegrid.sources import artefacts
from tonegrid.streaming.scoring import score_stream


@pytest.fixture(scope="module")
def corpus_rows():
    rng = random.Random(11)
    rows = []
    for i in range(160):
        label = "pos" if rng.random() < 0.6 else "neg"
        lean = 0 if label == "pos" else 8
        rows.append((i, label, [f"w{min(int(rng.random() * 20) + lean, 25)}" for _ in range(rng.randint(0, 9))]))
    return rows


@pytest.fixture(scope="module")
def train(spark, corpus_rows):
    return spark.createDataFrame(corpus_rows, "doc_id long, label string, tokens array<string>").repartition(4).persist()


@pytest.fixture(scope="module")
def features(spark):
    rows = [([f"w{i}"], i + 1) for i in range(26)] + [(["w1", "w2"], 27)]
    return spark.createDataFrame(rows, "feature array<string>, rank int")


def brute(rows, kind, keep=None):
    """Scores by the textbook formulas."""
    vocab = {w for _, _, t in rows for w in t if keep is None or w in keep}
    out = {}
    for c in ("pos", "neg"):
        own = [set(t) & vocab for _, l, t in rows if l == c]
        n = {w: sum(w in t for t in own) for w in vocab}
        total = sum(n.values())
        for i, _, t in rows:
            s = math.log(len(own) / len(rows))
            for w in vocab:
                if kind == nb.MULTINOMIAL:
                    s += math.log((n[w] + 1) / (total + len(vocab))) if w in t else 0.0
                else:
                    p = (n[w] + 1) / (len(own) + 2)
                    s += math.log(p if w in t else 1 - p)
            out[i, c] = s
    return out


@pytest.mark.parametrize("kind", [nb.MULTINOMIAL, nb.BERNOULLI])
@pytest.mark.parametrize("bound", [0, 26])
@pytest.mark.parametrize("selected", [True, False])
def test_naive_bayes_against_formulas(train, features, corpus_rows, kind, bound, selected, monkeypatch):
    monkeypatch.setattr(nb, "BROADCAST_ROWS", bound)
    keep = {f"w{i}" for i in range(10)} if selected else None
    chosen = features.where("rank <= 10") if selected else None
    model = nb.fit(train, chosen, kind)
    want = brute(corpus_rows, kind, keep)
    for r in model.transform(train).collect():
        assert r.s_pos == pytest.approx(want[r.doc_id, "pos"]) and r.s_neg == pytest.approx(want[r.doc_id, "neg"])
        assert r.prediction == float(r.s_pos > r.s_neg)


def test_naive_bayes_agrees_with_spark_ml(train):
    words = sorted({w for r in train.collect() for w in r.tokens})
    rows = classifiers.vectorizer(words).transform(classifiers.numeric_label(train))
    ml = NaiveBayes(smoothing=1.0).fit(rows).transform(rows).select("doc_id", F.col("prediction").alias("ml"))
    ours = nb.fit(train).transform(train)
    same = ours.join(ml, "doc_id").where("prediction = ml").count()
    assert same >= 158  # Spark smooths the prior too


def test_unseen_words_and_pairs_are_ignored(spark, train, features):
    model = nb.fit(train, features)
    odd = spark.createDataFrame([(1, ["never", "seen"]), (2, [])], "doc_id long, tokens array<string>")
    a, b = model.transform(odd).collect()
    assert (a.s_pos, a.s_neg) == (b.s_pos, b.s_neg) == model.bias


def test_metrics_by_hand(spark):
    rows = [(1.0, 1.0)] * 3 + [(1.0, 0.0)] + [(0.0, 1.0)] * 2 + [(0.0, 0.0)] * 4
    df = spark.createDataFrame(rows, "label double, prediction double")
    m = evaluate.metrics(df).first()
    assert (m.tp, m.fp, m.tn, m.fn, m.n) == (3, 2, 4, 1, 10)
    assert m.accuracy == 0.7 and m.error_rate == pytest.approx(0.3)
    assert m.auc_hard == pytest.approx((0.75 + 1 - 2 / 6) / 2)
    assert m.auc_hard == pytest.approx(evaluate.auc_ranked(df, "prediction"))
    assert (m.precision, m.recall, m.f1) == (0.6, 0.75, pytest.approx(6 / 9))
    points = [(r.fpr, r.tpr) for r in evaluate.roc_points(df).orderBy("point").collect()]
    assert points == [(0.0, 0.0), (2 / 6, 0.75), (1.0, 1.0)]
    assert evaluate.metrics(df.where("label = 1")).first().auc_hard is None


@pytest.mark.parametrize("kind", [nb.MULTINOMIAL, nb.BERNOULLI])
def test_sweep_equals_separate_fits(train, features, kind):
    ks = [1, 5, 12, 26]
    got = {r.k: r.auc_hard for r in sweeps.naive_bayes_sweep(train, train, features, ks, kind).collect()}
    for k in ks:
        model = nb.fit(train, features.where(F.col("rank") <= k), kind)
        want = evaluate.auc_hard(classifiers.numeric_label(model.transform(train))).first()[0]
        assert got[k] == pytest.approx(want)


def test_linear_sweep_and_best(train, features):
    series = sweeps.feature_count_sweep(train, train, features, ["LogisticRegression", "MultinomialNB"], [5, 20])
    rows = {(r.model, r.k): r.auc_hard for r in series.collect()}
    assert len(rows) == 4
    model = classifiers.fit("LogisticRegression", train, features.where("rank <= 20"))
    want = evaluate.auc_hard(classifiers.numeric_label(model.transform(train))).first()[0]
    assert rows["LogisticRegression", 20] == pytest.approx(want)
    best = evaluate.best_of(series.where("model = 'MultinomialNB'")).first()
    assert best.auc_hard == max(v for (m, _), v in rows.items() if m == "MultinomialNB")


@pytest.mark.parametrize("name", list(classifiers.CLASSIFIERS))
def test_each_classifier_learns_and_survives_a_round_trip(spark, train, features, tmp_path, name):
    model = classifiers.fit(name, train, features)
    scored = model.transform(train)
    assert evaluate.accuracy(classifiers.numeric_label(scored)).first()[0] > 0.6
    model.save(str(tmp_path / "m"))
    again = classifiers.load(spark, str(tmp_path / "m")).transform(train)
    pick = lambda df: sorted((r.doc_id, r.prediction) for r in df.collect())
    assert pick(again) == pick(scored) and len(pick(scored)) == 160


def test_random_features_approximate_the_gaussian_kernel(spark):
    docs = [(0, ["a", "b", "c"]), (1, ["a", "b"]), (2, ["d"]), (3, [])]
    df = spark.createDataFrame(docs, "doc_id long, tokens array<string>")
    words = spark.createDataFrame([(w,) for w in "abcd"], "word string")
    model = classifiers.FourierModel(words, 4, 4000, 0.25, 1)
    z = {r.doc_id: r.features.toArray() for r in model.features(df).collect()}
    for i, s in docs:
        for j, t in docs:
            want = math.exp(-0.25 * len(set(s) ^ set(t)))
            assert float(z[i] @ z[j]) == pytest.approx(want, abs=0.06)


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(200):
        v = [rng.gauss(0, 1) for _ in range(6)]
        rows.append((float(v[0] + v[1] * v[2] + rng.gauss(0, 0.3) > 0), v))
    return dense.to_vectors(spark.createDataFrame(rows, "label double, features array<double>")).persist()


@pytest.mark.parametrize("name", list(dense.DENSE))
def test_dense_models(points, name):
    model = dense.fit(name, points, **({"iterations": 10} if name == "GBT" else {}))
    assert evaluate.accuracy(model.transform(points)).first()[0] > 0.7


def test_staged_predictions_equal_shorter_fits(points):
    model = dense.fit("GBT", points, iterations=12, seed=4)
    staged = dense.staged_predictions(model, points, [1, 5, 12])
    last = {tuple(r.features): r.margin for r in staged.where("k = 12").collect()}
    for r in model.transform(points).collect():
        assert last[tuple(r.features)] == pytest.approx(r.rawPrediction[1], abs=1e-9)
    short = dense.fit("GBT", points, iterations=5, seed=4).transform(points)
    want = {tuple(r.features): r.prediction for r in short.collect()}
    assert {tuple(r.features): r.prediction for r in staged.where("k = 5").collect()} == want


def test_sentence_model_with_boosted_trees(spark, points, docs, tmp_path):
    model = VectorSentimentModel.fit(points, iterations=3)
    model.save(str(tmp_path / "gbt"))
    words = spark.createDataFrame([("good", [1.0] * 6), ("bad", [-1.0] * 6)], "word string, vec array<float>")
    got = VectorSentimentModel.load(str(tmp_path / "gbt")).predict(docs, words)
    assert got.count() == 5 and {"doc_id", "label", "prediction"} <= set(got.columns)


def test_load_or_train(spark, train, tmp_path, monkeypatch):
    root = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        SentimentModel.load(spark, root, "MultinomialNB", k=20)
    built = SentimentModel.load(spark, root, "MultinomialNB", train, k=20)
    monkeypatch.setattr(SentimentModel, "fit", None)  # a second load must not train
    loaded = SentimentModel.load(spark, root, "MultinomialNB", k=20)
    assert loaded.features.count() == 20
    assert built.score(train) == loaded.score(train) > 0.5
    texts = spark.createDataFrame([(0, "w1 w2, W3!"), (1, "")], "id long, text string")
    assert loaded.predict_text(texts, flags=()).count() == 2
    assert artefacts.exists(spark, artefacts.features_path(root, 20)) and not artefacts.exists(spark, root + "/none")


def test_generic_load_or_build(spark, tmp_path):
    path, built = str(tmp_path / "t"), []
    args = (spark.read.parquet, lambda: built.append(1) or spark.range(3), lambda df, p: df.write.parquet(p))
    for _ in range(2):
        assert artefacts.load_or_build(spark, path, *args).count() == 3
    assert built == [1]


def test_stream_scores_equal_batch(spark, train, tmp_path):
    src = str(tmp_path / "in")
    train.select("doc_id", "tokens").write.parquet(src)
    model = nb.fit(train)
    stream = spark.readStream.schema("doc_id long, tokens array<string>").option("maxFilesPerTrigger", 1).parquet(src)
    sink = str(tmp_path / "out")
    score_stream(stream, model.transform, sink, str(tmp_path / "state")).awaitTermination()
    pick = lambda df: sorted((r.doc_id, r.prediction) for r in df.collect())
    assert pick(spark.read.parquet(sink)) == pick(model.transform(train))


def test_attach_label_takes_an_extractor(docs):
    rows = corpus.attach_label(docs.drop("label"), "pos", corpus.bag_of_words)
    assert rows.columns == ["doc_id", "token", "label"] and rows.count() == 8


@pytest.mark.parametrize("limit", [0, 10**6])
def test_documents_partitioned_by_id_stay_whole(spark, train, monkeypatch, limit):
    monkeypatch.setattr(nb, "BROADCAST_ROWS", limit)
    model = nb.fit(train)
    by_id = train.repartition(16, "doc_id")
    pick = lambda df: sorted((r.doc_id, round(r.s_pos, 6)) for r in df.collect())
    assert pick(model.transform(by_id)) == pick(model.transform(train)) and len(pick(model.transform(by_id))) == 160
    both = corpus.stack(by_id.select("doc_id", "label"), corpus.bag_of_words(by_id).select("doc_id", "label"))
    assert both.groupBy("doc_id").count().count() == 160


def test_drawn_vectors_are_those_of_the_word_table(spark, monkeypatch):
    """Beyond the broadcast bound vectors are drawn where they are added up: the same features, and no vector travels per word."""
    rng = random.Random(4)
    docs = [(i, "pos", [rng.choice(["é", "w", "long word"]) + str(int(rng.paretovariate(0.5)))[:6] for _ in range(rng.randint(0, 60))]) for i in range(80)]
    docs += [(3, "pos", docs[3][2]), (90, None, None), (91, "neg", ["never", None]), (None, "neg", docs[5][2])]
    df = spark.createDataFrame(docs, "doc_id long, label string, tokens array<string>").repartition(5)
    words = spark.createDataFrame([(w,) for w in sorted({w for d in docs[:80] for w in d[2]})] + [("w1",)], "word string")
    model = classifiers.FourierModel(words, words.count(), 50, 0.01, 7)
    table = {r.word: r.vec for r in model.gaussians().collect()}
    codes = words.select("word", F.xxhash64("word").alias("code")).distinct().collect()
    drawn = classifiers.gaussian_columns(np.array([r.code for r in codes]), 3, 50, 7) * (2 * 0.01) ** 0.5
    assert np.allclose(drawn, [table[r.word][3:] for r in codes], atol=1e-12)
    key = lambda r: (r.doc_id is None, r.doc_id or 0, str(r.label))
    joined = sorted(model.features(df).collect(), key=key)
    monkeypatch.setattr(classifiers, "BROADCAST_CELLS", 0)
    monkeypatch.setattr(classifiers, "sentence_vectors", None)
    mine = sorted(model.features(df).collect(), key=key)
    assert [key(r) for r in mine] == [key(r) for r in joined] and len(mine) == 83
    assert np.allclose([r.features.toArray() for r in mine], [r.features.toArray() for r in joined], atol=1e-9)
