"""One named query per operator, each over whole tables: ``name -> (spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels, text
from ..operators import association, corpus, counts, evaluate, segment, split, vectors
from ..operators import naive_bayes as nb
from ..plans import classifiers, dense, linear, sweeps, trees
from ..plans.selection import select_features
from ..plans.sentiment import SentimentModel, VectorSentimentModel
from ..session import materialize, scratch_path, tune
from ..sources import artefacts, corpora
from ..sources.json_arrays import read_json_arrays
from ..streaming.scoring import score_stream
from . import tables as t

QUERIES = {}


def query(fn):
    def run(spark, sf):
        return fn(tune(spark), sf)

    QUERIES[fn.__name__] = run
    return fn


def shown(features: DataFrame, *columns: str) -> DataFrame:
    return features.select(text.feature_text(F.col("feature")).alias("feature"), *columns)


# text and sources


@query
def text_vectors_roundtrip(spark, sf):
    """Word vectors written as lines ``word v1 … vn`` and read back."""
    path = scratch_path(spark, "word_vectors")
    table = t.word_vectors(spark, sf)
    table.select(F.concat_ws(" ", "word", F.transform("vec", lambda v: v.cast("string"))).alias("value")).write.text(path)
    back = corpora.read_word_vectors_text(spark, path)
    return back.select("word", F.posexplode("vec").alias("dim", "v")).select("word", "dim", F.col("v").cast("double").alias("value"))


@query
def corpus_tokens(spark, sf):
    return corpus.flatten(t.labelled(spark, sf))


@query
def json_corpus_roundtrip(spark, sf):
    path = scratch_path(spark, "tokens")
    corpora.write_token_lines(t.labelled(spark, sf), path)
    back = corpora.read_token_lines(spark, path)
    return back.select("doc_id", "label", F.size("tokens").alias("n_tokens"), F.array_join("tokens", " ").alias("words"))


@query
def json_array_corpus(spark, sf):
    docs = t.labelled(spark, sf)
    parts = []
    for label in ("pos", "neg"):
        path = scratch_path(spark, label)
        bundle = docs.where(F.col("label") == label).select(F.to_json(F.array("tokens")).alias("value"))
        bundle.write.text(path)
        parts.append(corpora.read_json_corpus(spark, path, label, whole_file=False))
    words = F.array_join("tokens", " ").alias("words")
    return corpus.stack(*parts).groupBy("label", words).agg(F.count("*").alias("n"))


@query
def json_two_files(spark, sf):
    """Both classes as JSON arrays, read by byte range: unique ids over all files."""
    docs, paths = t.labelled(spark, sf), {}
    for label in ("pos", "neg"):
        paths[label] = scratch_path(spark, label)
        docs.where(F.col("label") == label).select(F.to_json(F.array("tokens")).alias("value")).write.text(paths[label])
    rows = read_json_arrays(spark, paths)
    words = F.array_join("tokens", " ").alias("words")
    return rows.groupBy("label", words).agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_ids"))


@query
def csv_vector_scan(spark, sf):
    rows = t.table(spark, sf, "embeddings")
    wide = rows.select(
        F.when(F.col("label") < 5, "p").otherwise("n").alias("label"),
        *[F.col("embedding")[i].cast("double").alias(f"v{i + 1}") for i in range(t.DIM)],
    )
    path = scratch_path(spark, "vectors")
    corpora.write_dense_csv(wide, path)
    back = corpora.dense_rows(corpora.read_dense_csv(spark, path, t.DIM))
    return back.select("label", F.posexplode("features").alias("dim", "value"))


@query
def stopword_antijoin(spark, sf):
    path = scratch_path(spark, "stopwords")
    words = t.stopwords(spark, sf).agg(F.to_json(F.collect_list("token")).alias("value"))  # a 50-word list
    words.write.text(path)
    kept = corpus.remove_stopwords(t.documents(spark, sf), corpora.read_stopwords(spark, path))
    return corpus.flatten(kept)


@query
def stopword_rows(spark, sf):
    rows = corpus.flatten(t.documents(spark, sf))
    return corpus.remove_stopword_rows(rows, t.stopwords(spark, sf))


@query
def flag_filter(spark, sf):
    docs = t.raw_documents(spark, sf)
    rows = corpus.flatten(corpus.tokenize(docs, pattern=text.LETTERS_DIGITS, min_length=1))
    return corpus.remove_flags(rows, flags=["m", "mq"])


@query
def flag_filter_default(spark, sf):
    docs = t.raw_documents(spark, sf)
    rows = corpus.flatten(corpus.tokenize(docs, pattern=text.LETTERS_DIGITS, min_length=1))
    return corpus.remove_flags(rows)


@query
def clean_tokens(spark, sf):
    docs = t.raw_documents(spark, sf)
    return corpus.flatten(corpus.clean(docs, t.stopwords(spark, sf), flags=["m", "mq"]))


@query
def lexicon_segment(spark, sf):
    path = scratch_path(spark, "lexicon")
    t.lexicon(spark, sf).write.csv(path, sep=" ")
    joined = F.regexp_replace(F.lower("text"), "[ \\t\\r\\n]", "").alias("text")
    docs = t.raw_documents(spark, sf).select("doc_id", joined)
    done = segment.segmented(docs, corpora.read_lexicon(spark, path))
    return done.select("doc_id", F.size("tokens").alias("n_tokens"), F.array_join("tokens", " ").alias("words"))


@query
def bag_of_words(spark, sf):
    return corpus.bag_of_words(t.documents(spark, sf))


# counts and association


@query
def word_freq(spark, sf):
    return counts.word_freq(t.documents(spark, sf))


@query
def class_word_freq(spark, sf):
    return counts.class_word_freq(t.labelled(spark, sf))


@query
def class_totals(spark, sf):
    totals = counts.class_totals(t.labelled(spark, sf))
    return totals.select(F.coalesce("label", F.lit("all")).alias("label"), "n")


@query
def bigram_freq(spark, sf):
    return counts.bigram_freq(t.labelled(spark, sf))


@query
def bigram_freq_in_doc(spark, sf):
    return counts.bigram_freq(t.labelled(spark, sf), cross_docs=False)


@query
def doc_bigram_features(spark, sf):
    return shown(corpus.document_bigrams(t.documents(spark, sf)), "doc_id", "n", "score", "rank")


@query
def doc_words_bigrams(spark, sf):
    return shown(corpus.words_and_bigrams(t.documents(spark, sf)), "doc_id")


@query
def word_chi2(spark, sf):
    return association.word_scores(t.labelled(spark, sf))


@query
def top_words(spark, sf):
    return shown(t.top_words(spark, sf), "rank", "score")


@query
def bigram_chi2_top(spark, sf):
    return association.top_bigrams(t.labelled(spark, sf))


@query
def word_bigram_scores(spark, sf):
    return shown(association.word_bigram_scores(t.labelled(spark, sf)), "n_pos", "n_neg", "n", "score")


@query
def word_bigram_scores_negative(spark, sf):
    scored = association.word_bigram_scores(t.labelled(spark, sf), negative_pairs_only=True)
    return shown(scored, "n_pos", "n_neg", "n", "score")


@query
def main_features(spark, sf):
    return shown(select_features(t.labelled(spark, sf), t.K), "rank", "source")


@query
def feature_projection(spark, sf):
    docs = t.labelled(spark, sf)
    return shown(corpus.project(docs, select_features(docs, t.K)), "doc_id", "label")


@query
def feature_projection_bigrams(spark, sf):
    docs = t.labelled(spark, sf)
    return shown(corpus.project(docs, select_features(docs, t.K), match_bigrams=True), "doc_id", "label")


# vectors


@query
def nearest_words(spark, sf):
    table = t.word_vectors(spark, sf)
    chosen = t.top_words(spark, sf).select(F.col("feature")[0].alias("word"))
    return vectors.nearest_words(table.join(chosen, "word"), table)


@query
def nearest_words_lsh(spark, sf):
    """Recall of the banded search against the exact one."""
    table = t.word_vectors(spark, sf)
    chosen = table.join(t.top_words(spark, sf).select(F.col("feature")[0].alias("word")), "word")
    found = vectors.recall(vectors.nearest_words_lsh(chosen, table, t.DIM), vectors.nearest_words(chosen, table))
    return found.select("n_queries", "n_exact", (F.col("recall") >= 0.9).alias("enough"))


@query
def expand_features_pairs(spark, sf):
    pairs = association.top_bigrams(t.labelled(spark, sf), 50).select(F.array("w1", "w2").alias("feature"), "rank")
    return shown(vectors.expand_features(pairs.groupBy("feature").agg(F.min("rank").alias("rank")), t.word_vectors(spark, sf), pairs=True), "rank", "source")


@query
def expand_features(spark, sf):
    chosen = select_features(t.labelled(spark, sf), t.K, t.word_vectors(spark, sf))
    return shown(chosen, "rank", "source")


@query
def sentence_vector(spark, sf):
    summed = vectors.sentence_vectors(t.documents(spark, sf), t.word_vectors(spark, sf), t.DIM)
    return summed.select("doc_id", F.posexplode("vec").alias("dim", "v")).select("doc_id", "dim", F.round("v", 4).alias("value"))


# labels, sets and splits


@query
def relabel_null(spark, sf):
    flag = F.when(F.col("quality") == 1, "p").otherwise("n")
    return t.table(spark, sf, "labels").select("doc_id", labels.relabel(flag).alias("label"))


@query
def label_encode(spark, sf):
    flag = F.when(F.col("quality") == 1, "p").when(F.col("toxic") == 1, "n")
    return t.table(spark, sf, "labels").select("doc_id", labels.label_01(flag).alias("label"))


@query
def union_classes(spark, sf):
    rows = t.classes(spark, sf)
    return corpus.stack_positional(rows.where("label = 'neg'"), rows.where("label = 'pos'"))


@query
def row_counts(spark, sf):
    rows = t.classes(spark, sf)
    return rows.rollup("label").agg(F.count("*").alias("n")).select(F.coalesce("label", F.lit("all")).alias("label"), "n")


@query
def split_90_10(spark, sf):
    return split.positional_split(t.classes(spark, sf), 0.9, 42)


@query
def shuffle_order(spark, sf):
    return split.shuffled(t.classes(spark, sf), 42)


@query
def random_split(spark, sf):
    rows = t.classes(spark, sf)
    train, test = split.random_split(rows, 0.8, 42)
    return corpus.stack(train.withColumn("part", F.lit("train")), test.withColumn("part", F.lit("test")))


@query
def attach_label(spark, sf):
    docs = t.labelled(spark, sf)
    side = lambda label: corpus.attach_label(
        docs.where(F.col("label") == label).drop("label"), label, lambda d: corpus.project(d, t.top_words(spark, sf))
    )
    return shown(corpus.stack(side("pos"), side("neg")), "doc_id", "label")


# naive Bayes and metrics


def _naive_bayes(spark, sf, kind=nb.MULTINOMIAL):
    return nb.fit(t.labelled(spark, sf), t.top_words(spark, sf), kind)


def _rounded(scored, *keys):
    return scored.select(*keys, F.round("s_pos", 6).alias("s_pos"), F.round("s_neg", 6).alias("s_neg"), "prediction")


def _scored(spark, sf):
    return classifiers.numeric_label(_naive_bayes(spark, sf).transform(t.labelled(spark, sf)))


@query
def mnb_predict(spark, sf):
    return _rounded(_naive_bayes(spark, sf).transform(t.documents(spark, sf)), "doc_id")


@query
def bnb_predict(spark, sf):
    return _rounded(_naive_bayes(spark, sf, nb.BERNOULLI).transform(t.documents(spark, sf)), "doc_id")


@query
def mnb_all_words(spark, sf):
    model = nb.fit(t.labelled(spark, sf))
    return _rounded(model.transform(t.documents(spark, sf)), "doc_id")


@query
def mnb_accuracy(spark, sf):
    return evaluate.accuracy(_scored(spark, sf))


@query
def mnb_error_rate(spark, sf):
    return evaluate.error_rate(_scored(spark, sf))


@query
def mnb_auc_hard(spark, sf):
    return evaluate.auc_hard(_scored(spark, sf))


@query
def mnb_roc_points(spark, sf):
    return evaluate.roc_points(_scored(spark, sf))


@query
def mnb_confusion(spark, sf):
    return evaluate.metrics(_scored(spark, sf)).select("tp", "fp", "tn", "fn", "precision", "recall", "f1")


@query
def predict_text(spark, sf):
    rows = t.raw_turns(spark, sf)
    model = SentimentModel("MultinomialNB", t.K, t.top_words(spark, sf), classifiers.NaiveBayesModel(_naive_bayes(spark, sf)))
    scored = model.predict_text(rows, stopwords=t.stopwords(spark, sf), flags=["m", "mq"])
    return _rounded(scored, "conv_id", "turn")


@query
def predict_unspaced(spark, sf):
    """Turns without blanks: segmented by a lexicon whose two-letter words carry a dropped flag."""
    rows = t.raw_turns(spark, sf).withColumn("text", F.regexp_replace("text", "[ \\t\\r\\n]", ""))
    lexicon = t.lexicon(spark, sf).withColumn("flag", F.when(F.length("token") == 2, "m").otherwise("x"))
    model = SentimentModel("MultinomialNB", t.K, t.top_words(spark, sf), classifiers.NaiveBayesModel(_naive_bayes(spark, sf)))
    scored = model.predict_text(rows, stopwords=t.stopwords(spark, sf), lexicon=lexicon, flags=["m"])
    return _rounded(scored, "conv_id", "turn")


@query
def predict_tokens(spark, sf):
    model = SentimentModel("MultinomialNB", t.K, t.top_words(spark, sf), classifiers.NaiveBayesModel(_naive_bayes(spark, sf)))
    return _rounded(model.predict_tokens(t.conversations(spark, sf)), "conv_id", "turn")


@query
def feature_count_sweep(spark, sf):
    docs = t.labelled(spark, sf)
    return sweeps.feature_count_sweep(docs, docs, t.top_words(spark, sf), ["MultinomialNB", "BernoulliNB"])


@query
def best_feature_count(spark, sf):
    docs = t.labelled(spark, sf)
    return evaluate.best_of(sweeps.naive_bayes_sweep(docs, docs, t.top_words(spark, sf)))


# fitted models: results depend on the optimiser, so these have no SQL counterpart


def _report(name, scored):
    return evaluate.metrics(classifiers.numeric_label(scored)).select(
        F.lit(name).alias("model"), "n", "accuracy", "error_rate", "auc_hard"
    )


def _selected_model(name):
    def run(spark, sf):
        docs = t.labelled_once(spark, sf)
        model = classifiers.fit(name, docs, materialize(t.best_words(docs)))
        return _report(name, model.transform(docs))

    return run


for _key, _name in {"lr": "LogisticRegression", "linear_svc": "LinearSVC", "rbf_svc": "SVC", "nu_svc": "NuSVC"}.items():
    QUERIES[f"{_key}_fit_score"] = _selected_model(_name)


def _dense_model(name, **params):
    def run(spark, sf):
        train, test = t.dense_split(spark, sf)
        scored = dense.fit(name, train, **params).transform(test)
        return evaluate.metrics(scored).select(F.lit(name).alias("model"), "n", "error_rate", "auc_hard")

    return run


QUERIES["dense_lr"] = _dense_model("LogisticRegression")
QUERIES["dense_tree"] = _dense_model("DecisionTree")
QUERIES["dense_forest"] = _dense_model("RandomForest")
QUERIES["dense_gbt"] = _dense_model("GBT")


def _node_table(name, **params):
    """The model as a node table scored by joins, against its own transform."""

    def run(spark, sf):
        train, test = t.keyed_dense_split(spark, sf)
        model = dense.fit(name, train, **params)
        return trees.agreement(model, test).select(F.lit(name).alias("model"), "n", "same")

    return run


QUERIES["dense_tree_nodes"] = _node_table("DecisionTree")
QUERIES["dense_forest_nodes"] = _node_table("RandomForest")
QUERIES["dense_gbt_nodes"] = _node_table("GBT")


@query
def gbt_stages_nodes(spark, sf):
    """Stages of boosting from the node table, against those from leaf numbers."""
    train, test = t.keyed_dense_split(spark, sf)
    stages = list(range(1, 30, 5))
    model = dense.fit("GBT", train, iterations=max(stages))
    mine = trees.node_model(model).staged(test.select("vec_id", "features"), stages).select("vec_id", "k", F.col("prediction").alias("p"))
    both = dense.staged_predictions(model, test, stages).join(mine, ["vec_id", "k"])
    return both.groupBy("k").agg(F.count("*").alias("n"), F.count_if(F.col("p") == F.col("prediction")).alias("same"))


@query
def gbt_error_sweep(spark, sf):
    train, test = t.dense_split(spark, sf)
    return dense.iteration_sweep(train, test, list(range(1, 30, 5))).select("k", "error_rate")


@query
def gbt_auc_sweep(spark, sf):
    train, test = t.dense_split(spark, sf)
    series = dense.iteration_sweep(train, test, list(range(1, 500, 5))).select("k", "auc_hard")
    return series.withColumn("best_k", evaluate.best_of(series).select("k").scalar())


@query
def model_compare(spark, sf):
    docs = t.labelled_once(spark, sf)
    return sweeps.compare(docs, docs)


@query
def all_words_lr(spark, sf):
    """Logistic regression on every word: its gradient is measured again from the word table, at the start and at the end."""
    docs = t.labelled_once(spark, sf)
    model = linear.fit_linear(docs, tolerance=1e-3)
    n, first = docs.count(), model.report["first"]
    last = linear.gradient_length(model, docs, 1.0 / n)
    row = [(model.size, n, round(first, 6), last <= 1.001e-3 * first)]
    return spark.createDataFrame(row, "n_words long, n_docs long, first_gradient double, converged boolean")


@query
def lr_feature_sweep(spark, sf):
    docs = materialize(split.positional_split(t.labelled(spark, sf), 0.9, 42))
    train, test = (docs.where(F.col("part") == p).drop("part") for p in ("train", "test"))
    return sweeps.feature_count_sweep(train, test, t.best_words(train), ["LogisticRegression"])


@query
def sentiment_held_out(spark, sf):
    """Split, selection with pairs and expansion on the train part, naive Bayes, scores of the held-out part."""
    docs = materialize(split.positional_split(t.labelled(spark, sf), 0.9, 42))
    train, test = (docs.where(F.col("part") == p).drop("part") for p in ("train", "test"))
    features = materialize(select_features(train, t.K, t.word_vectors(spark, sf)))
    scored = classifiers.fit("MultinomialNB", train, features).transform(test)
    return evaluate.metrics(classifiers.numeric_label(scored)).select("tp", "fp", "tn", "fn", "auc_hard")


# saved artefacts


@query
def features_roundtrip(spark, sf):
    root = scratch_path(spark, "store")
    artefacts.save_features(select_features(t.labelled(spark, sf), t.K), root, t.K)
    return shown(artefacts.load_features(spark, root, t.K), "rank", "source")


def _agreement(name, first, second, keys):
    a = first.select(*keys, F.col("prediction").alias("a"))
    both = a.join(second.select(*keys, F.col("prediction").alias("b")), keys)
    return both.agg(F.count("*").alias("n"), F.count_if(F.col("a") == F.col("b")).alias("same")).select(
        F.lit(name).alias("model"), "n", "same"
    )


@query
def model_roundtrip(spark, sf):
    docs, root = t.labelled_once(spark, sf), scratch_path(spark, "store")
    words, parts = materialize(t.best_words(docs)), []
    for name in ("MultinomialNB", "LogisticRegression", "SVC"):
        path = artefacts.model_path(root, name, t.K)
        model = classifiers.fit(name, docs, words)
        model.save(path)
        parts.append(_agreement(name, model.transform(docs), classifiers.load(spark, path).transform(docs), ["doc_id"]))
    return reduce(DataFrame.unionByName, parts)


@query
def load_or_build(spark, sf):
    docs, root = t.labelled_once(spark, sf), scratch_path(spark, "store")
    built = SentimentModel.load(spark, root, "BernoulliNB", docs, t.K, seed=42)
    loaded = SentimentModel.load(spark, root, "BernoulliNB", k=t.K)
    return _agreement("BernoulliNB", built.predict_tokens(docs), loaded.predict_tokens(docs), ["doc_id"])


@query
def sentence_vector_gbt(spark, sf):
    model = VectorSentimentModel.fit(t.dense_rows(spark, sf))
    path = scratch_path(spark, "boosted")
    model.save(path)
    loaded = VectorSentimentModel.load(path)
    return loaded.predict(t.conversations(spark, sf), t.word_vectors(spark, sf)).select("conv_id", "turn", "prediction")


@query
def sentence_text_gbt(spark, sf):
    """Raw sentences through a boosted model: as many predictions as turns, equal to those of their tokens."""
    model, words = VectorSentimentModel.fit(t.dense_rows(spark, sf), iterations=10), t.word_vectors(spark, sf)
    raw = model.predict_text(t.raw_turns(spark, sf), words, pattern=text.LETTERS, flags=())
    return _agreement("GBT", raw, model.predict(t.conversations(spark, sf), words), ["conv_id", "turn"])


# streams


@query
def score_documents_stream(spark, sf):
    model = _naive_bayes(spark, sf)
    schema = t.table(spark, sf, "documents").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf}/documents*.parquet")
    sink, state = scratch_path(spark, "scored"), scratch_path(spark, "progress")
    score = lambda batch: model.transform(corpus.tokenize(batch.select("doc_id", "text")))
    score_stream(stream, score, sink, state).awaitTermination()
    return _rounded(spark.read.parquet(sink), "doc_id")
