import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonegrid.operators import evaluate
from tonegrid.plans import classifiers, linear


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    for i in range(300):
        label = "pos" if rng.random() < 0.55 else "neg"
        lean = 0 if label == "pos" else 40
        words = [f"w{min(int(rng.expovariate(0.03)) + (lean if rng.random() < 0.5 else 0), 1500)}" for _ in range(rng.randint(0, 14))]
        out.append((i, label, [*words, f"only{i}", f"once{i}", f"rare{i % 150}", f"seen{i}"]))
    return out + [(300, "pos", []), (301, "neg", None)]


@pytest.fixture(scope="module")
def train(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, label string, tokens array<string>").repartition(4).persist()


def dense(rows):
    words = sorted({w for _, _, t in rows for w in t or []})
    at = {w: i for i, w in enumerate(words)}
    x = np.zeros((len(rows), len(words)))
    for i, (_, _, t) in enumerate(rows):
        x[i, [at[w] for w in t or []]] = 1
    return words, x, np.array([1.0 if label == "pos" else -1.0 for _, label, _ in rows])


def test_direction_equals_the_two_loop_recursion():
    rng = np.random.default_rng(1)
    s, g = rng.standard_normal((3, 7)), rng.standard_normal(7)
    y = s @ np.diag(rng.uniform(0.5, 2, 7))
    q, alphas = -g, []
    for i in reversed(range(3)):
        alphas.append(q @ s[i] / (s[i] @ y[i]))
        q = q - alphas[-1] * y[i]
    q = q * (s[2] @ y[2]) / (y[2] @ y[2])
    for i in range(3):
        q = q + (alphas[2 - i] - q @ y[i] / (s[i] @ y[i])) * s[i]
    basis = np.vstack([s, y, g[None]])
    assert np.allclose(linear.direction(basis @ basis.T, 3) @ basis, q)


def test_word_index_follows_word_order(spark):
    words = spark.createDataFrame([(f"w{i % 500:03d}",) for i in range(1200)], "word string").repartition(9)
    store = linear.Store(spark)
    got = [(r.id, r.word) for r in linear.word_index(words, store).orderBy("id").collect()]
    store.close()
    assert got == [(i, f"w{i:03d}") for i in range(500)]


@pytest.mark.parametrize("loss", linear.LOSSES)
def test_fit_reaches_the_minimum(spark, train, rows, loss):
    """Many small blocks: loss and gradient are those of the weights, and next to the best found by a dense solver."""
    n = len(rows)
    words, x, y = dense(rows)
    model = linear.fit_linear(train, loss=loss, tolerance=1e-3, most=25, rows=60, cells=500)
    got = {r.feature: r.w for r in model.weights.collect()}
    assert sorted(got) == words and model.size == len(words) > 1000
    w = np.array([got[v] for v in words])
    value = lambda w, b: linear.losses(x @ w + b, y, loss) / n + w @ w / (2 * n)
    assert value(w, model.bias) == pytest.approx(model.report["loss"], rel=1e-6)
    best, best_b = np.zeros(len(words)), 0.0  # plain descent on the same objective
    for _ in range(8000):
        push = linear.slope(x @ best + best_b, y, loss) / n
        step = 2.0 if loss == "logistic" else 0.3
        best, best_b = best - step * (x.T @ push + best / n), best_b - step * push.sum()
    assert value(w, model.bias) <= value(best, best_b) * (1.01 if loss == "logistic" else 1.05)
    push = linear.slope(x @ w + model.bias, y, loss) / n
    length = np.sqrt(((x.T @ push + w / n) ** 2).sum() + push.sum() ** 2)
    assert length == pytest.approx(model.report["gradient"], rel=1e-6)
    assert linear.gradient_length(model, train, 1 / n, loss) == pytest.approx(length, rel=1e-6)


def test_the_bound_picks_the_form_not_the_result(spark, train, rows, monkeypatch, tmp_path):
    """With the bound lowered to 1000 words a selection of more is fitted by the table form, to the same model."""
    train = train.where("tokens IS NOT NULL")  # Spark ML takes none
    words = sorted({w for _, _, t in rows for w in t or []})
    features = spark.createDataFrame([([w], i + 1) for i, w in enumerate(words)], "feature array<string>, rank int")
    few = classifiers.fit("LogisticRegression", train, features)
    monkeypatch.setattr(classifiers, "MAX_VOCABULARY", 1000)
    many = classifiers.fit("LogisticRegression", train, features)
    assert isinstance(few, classifiers.PresenceModel) and isinstance(many, classifiers.TableModel)
    sides = [{r.doc_id: r.prediction for r in m.transform(train).collect()} for m in (few, many)]
    assert sum(sides[0][i] == sides[1][i] for i in sides[0]) >= len(rows) - 3
    many.save(str(tmp_path / "m"))
    again = classifiers.load(spark, str(tmp_path / "m"))
    assert {r.doc_id: r.prediction for r in again.transform(train).collect()} == sides[1]
    some = classifiers.fit("LogisticRegression", train, features.where("rank <= 10"))
    assert isinstance(some, classifiers.PresenceModel)


def test_odd_corpora(spark, train):
    """Unseen words count nothing; one class, empty tables and documents without words give a model."""
    model = linear.fit_linear(train.where("label = 'pos'"), most=5)
    odd = spark.createDataFrame([(1, ["never"], "x"), (2, [], "y")], "doc_id long, tokens array<string>, extra string")
    a, b = model.transform(odd).orderBy("doc_id").collect()
    assert a.margin == b.margin == model.bias > 0 and a.extra == "x"
    none = linear.fit_linear(train.limit(0))
    assert none.size == 0 and none.transform(odd).where("prediction = 0").count() == 2
    empty = linear.fit_linear(train.where("doc_id >= 300"), most=5)
    assert empty.size == 0 and abs(empty.bias) < 1e-6


def test_compare_takes_all_words(train):
    from tonegrid.plans import sweeps

    out = {r.model: r.accuracy for r in sweeps.compare(train, train, names=["LogisticRegression", "LinearSVC"]).collect()}
    assert set(out) == {"LogisticRegression", "LinearSVC"} and min(out.values()) > 0.8


def test_scratch_is_left_clean(spark, train):
    import os

    from tonegrid.session import shared_dir

    before = set(os.listdir(shared_dir(spark)))
    linear.fit_linear(train, most=2)
    left = set(os.listdir(shared_dir(spark))) - before
    assert {name.split("-")[0] for name in left} <= {"weights"}


def test_a_vocabulary_of_many_parts_gives_the_same_fit(spark, train):
    """Values travel as one array per block and part; how the vocabulary is cut changes nothing."""
    fits = [linear.fit_linear(train, most=4, rows=60, cells=500, part=part) for part in (64, 1 << 16)]
    few, one = ({r.feature: r.w for r in m.weights.collect()} for m in fits)
    assert few.keys() == one.keys() and all(abs(few[v] - one[v]) < 1e-9 for v in one)
    assert fits[0].bias == pytest.approx(fits[1].bias) and fits[0].report["iterations"] == fits[1].report["iterations"]


def test_twelve_passes_reach_the_minimum_of_a_skewed_corpus(spark):
    """The minimum over the last steps and the gradient together: quasi-Newton steps needed 19 here."""
    rng, rows = random.Random(5), []
    for i in range(400):
        label = "pos" if rng.random() < 0.8 else "neg"
        many, words = rng.choice([5, 20, 80, 300]), []
        for _ in range(many):
            shift = 3 if label == "pos" and rng.random() < 0.3 else 0
            rng.random()
            words.append(f"w{int(rng.paretovariate(0.35)) + shift}"[:9])
        rows.append((i, label, words))
    docs = spark.createDataFrame(rows, "doc_id long, label string, tokens array<string>").repartition(2).persist()
    model = linear.fit_linear(docs, tolerance=1e-3, gain=0.0, most=12)
    assert model.report["gradient"] <= 1e-3 * model.report["first"]
    assert linear.gradient_length(model, docs, 1 / len(rows)) <= 1.001e-3 * model.report["first"]


def test_words_of_one_block_do_not_travel(spark, train):
    """A block sends and receives only words that other blocks have; the rest follow in its list of ids."""
    store = linear.Store(spark)
    blocks, index = linear.blocks_of(train, None, store, 60, 500)
    found = [(np.frombuffer(r.ids, np.int64).tolist(), r.shared) for r in blocks.collect()]
    n = index.count()
    store.close()
    times = np.bincount([i for ids, _ in found for i in ids], minlength=n)
    assert len(found) > 4 and (times > 0).all()
    for ids, shared in found:
        assert ids[:shared] == sorted(ids[:shared]) and all(times[i] > 1 for i in ids[:shared])
        assert all(times[i] == 1 for i in ids[shared:])
