from pyspark.sql import functions as F

from tonegrid.functions import labels, text
from tonegrid.operators import corpus, segment
from tonegrid.sources import corpora


def tokens(df, by="doc_id"):
    return {r[by]: list(r.tokens) for r in df.collect()}


def test_tokenize_keeps_order_and_drops_short(spark):
    df = spark.createDataFrame([(0, "A Good, good day"), (1, ""), (2, "é x été")], "doc_id long, text string")
    assert tokens(corpus.tokenize(df)) == {0: ["good", "good", "day"], 1: [], 2: ["été"]}


def test_flags(spark):
    df = spark.createDataFrame([("42",), ("abc1",), ("été",), ("國家",)], "token string")
    got = {r.token: r.f for r in df.select("token", text.token_flag(F.col("token")).alias("f")).collect()}
    assert got == {"42": "m", "abc1": "eng", "été": "x", "國家": "x"}


def test_default_clean_drops_latin_and_numbers(spark):
    df = spark.createDataFrame([(0, "國家 needs 12 情緒 的")], "doc_id long, text string")
    assert tokens(corpus.clean(df)) == {0: ["國家", "情緒"]}


def test_lexicon_flags_win_over_derived_ones(spark):
    rows = spark.createDataFrame([(0, 0, "三個"), (0, 1, "good"), (0, 2, "國家")], "doc_id long, pos int, token string")
    lexicon = spark.createDataFrame([("三個", 1, "mq"), ("good", 1, "a")], "token string, freq long, flag string")
    assert [r.token for r in corpus.remove_flags(rows, lexicon).orderBy("pos").collect()] == ["good", "國家"]


def test_stopwords_both_ways(spark, docs, monkeypatch):
    words = spark.createDataFrame([("good",), ("",), ("good",), ("film",)], "token string")
    expected = {0: ["day"], 1: [], 2: [], 3: ["bad", "day"], 4: ["bad", "bad"]}
    assert tokens(corpus.remove_stopwords(docs, words)) == expected
    monkeypatch.setattr(corpus, "INLINE_WORDS", 1)
    assert tokens(corpus.remove_stopwords(docs, words)) == expected
    rows = corpus.remove_stopword_rows(corpus.flatten(docs), words)
    assert [(r.doc_id, r.pos) for r in rows.orderBy("doc_id", "pos").collect()] == [(0, 2), (3, 0), (3, 1), (4, 0), (4, 2)]


def test_bag_counts_presence_once(docs):
    assert sorted((r.doc_id, r.token) for r in corpus.bag_of_words(docs).collect()) == [
        (0, "day"), (0, "good"), (2, "film"), (2, "good"), (3, "bad"), (3, "day"), (4, "bad"), (4, "film"),
    ]


def test_projection_matches_pairs_only_on_request(spark, docs):
    features = spark.createDataFrame([(["bad"],), (["good", "film"],)], "feature array<string>")
    got = lambda **o: sorted((r.doc_id, tuple(r.feature)) for r in corpus.project(docs, features, **o).collect())
    assert got() == [(3, ("bad",)), (4, ("bad",))]
    assert got(match_bigrams=True) == [(2, ("good", "film")), (3, ("bad",)), (4, ("bad",))]


def test_document_bigrams_against_brute_force(docs):
    from collections import Counter

    want = set()
    for r in docs.collect():
        t = r.tokens
        words, pairs, n = Counter(t), Counter(zip(t, t[1:])), len(t)
        for (a, b), ii in pairs.items():
            ix, xi = words[a], words[b]
            io, oi = ix - ii, xi - ii
            oo = n - ii - io - oi
            den = ix * xi * (io + oo) * (oi + oo)
            want.add((r.doc_id, a, b, ii, round(n * (ii * oo - io * oi) ** 2 / den, 6) if den else None))
    got = {(r.doc_id, *r.feature, r.n, r.score) for r in corpus.document_bigrams(docs).collect()}
    assert got == want
    top = corpus.document_bigrams(docs, n=1).collect()
    assert {r.doc_id: tuple(r.feature) for r in top} == {
        0: ("good", "day"), 2: ("good", "film"), 3: ("bad", "day"), 4: ("bad", "film"),
    }


def test_document_bigrams_stay_in_their_row(spark, tmp_path):
    """No exchange; rows of one id are documents of their own; NULL and short documents have no pair; a long one is whole."""
    long = [f"w{i % 700}" for i in range(50_000)]
    rows = [(1, ["a", "b"]), (1, ["a", "b", "a"]), (2, None), (3, ["x"]), (4, []), (5, long)]
    spark.createDataFrame(rows, "doc_id long, tokens array<string>").write.parquet(str(tmp_path / "t"))
    out = corpus.document_bigrams(spark.read.parquet(str(tmp_path / "t")), 2000)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, []).append((tuple(r.feature), r.n))
    assert sorted(got[1]) == [(("a", "b"), 1), (("a", "b"), 1), (("b", "a"), 1)] and set(got) == {1, 5}
    assert len(got[5]) == 700 and sum(n for _, n in got[5]) == 49_999


def test_score_function_is_a_parameter(docs):
    by_count = corpus.document_bigrams(docs, 1, lambda n_ii, n_ix, n_xi, n_xx: n_ii / n_xx)
    assert by_count.where("doc_id = 4").first().feature == ["bad", "film"]


def test_words_and_bigrams(docs):
    rows = corpus.words_and_bigrams(docs).where("doc_id = 2").collect()
    assert sorted(tuple(r.feature) for r in rows) == [("film",), ("good",), ("good", "film")]


def test_segmentation(spark):
    lexicon = spark.createDataFrame([(w, 1, "n") for w in "國家 需要 情緒 正面 正面情緒".split()], "token string, freq long, flag string")
    df = spark.createDataFrame([(0, "國家更需要正面情緒"), (1, ""), (2, "正面,情緒")], "doc_id long, text string")
    assert tokens(segment.segmented(df, lexicon)) == {0: ["國家", "需要", "正面情緒"], 1: [], 2: ["正面", "情緒"]}
    assert tokens(segment.segmented(df, lexicon, flags=["n"])) == {0: [], 1: [], 2: []}


def test_segmentation_against_brute_force(spark):
    import random

    rng = random.Random(5)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(30)}
    texts = [(i, "".join(rng.choice("abc ,") for _ in range(60))) for i in range(40)]

    def walk(s):
        out, i = [], 0
        while i < len(s):
            best = next((s[i : i + n] for n in range(5, 0, -1) if s[i : i + n] in words and len(s[i : i + n]) == n), None)
            if best and len(best) > 1:
                out.append(best)
            i += len(best) if best else 1
        return out

    lexicon = spark.createDataFrame([(w, 1, None) for w in words], "token string, freq long, flag string")
    got = tokens(segment.segmented(spark.createDataFrame(texts, "doc_id long, text string"), lexicon))
    assert got == {i: walk(s) for i, s in texts}


def test_relabel_and_encode_handle_null(spark):
    df = spark.createDataFrame([("p",), ("x",), (None,)], "c string")
    got = df.select(labels.relabel(F.col("c")).alias("r"), labels.label_01(F.col("c")).alias("e")).collect()
    assert [(r.r, r.e) for r in got] == [("n", 1.0), (None, 0.0), (None, 0.0)]


def test_json_corpus_stopwords_lexicon_and_vectors(spark, tmp_path):
    (tmp_path / "pos.json").write_text('[["國家","好"],[],["a"]]', encoding="utf-8")
    got = corpora.read_json_corpus(spark, str(tmp_path / "pos.json"), "pos")
    assert [(r.doc_id, r.label, r.tokens) for r in got.orderBy("doc_id").collect()] == [
        (0, "pos", ["國家", "好"]), (1, "pos", []), (2, "pos", ["a"]),
    ]
    (tmp_path / "stop.json").write_text('["a","a",""]')
    assert [r.token for r in corpora.read_stopwords(spark, str(tmp_path / "stop.json")).collect()] == ["a"]
    (tmp_path / "lex.txt").write_text("國家 5 n\n\"好 3\n需要\n", encoding="utf-8")
    assert {r.token: (r.freq, r.flag) for r in corpora.read_lexicon(spark, str(tmp_path / "lex.txt")).collect()} == {
        "國家": (5, "n"), '"好': (3, None), "需要": (None, None),
    }
    (tmp_path / "vec.txt").write_text("2 3\ngood 1 0.5 -2\nbad 0 0 1e-3\n")
    vec = {r.word: r.vec for r in corpora.read_word_vectors_text(spark, str(tmp_path / "vec.txt")).collect()}
    assert vec["good"] == [1.0, 0.5, -2.0] and len(vec) == 2


def test_dense_csv_raises_on_bad_numbers(spark, tmp_path):
    import pytest

    (tmp_path / "a.csv").write_text("label,v1,v2\np,1,2\nx,3,4\n,5,6\n")
    rows = corpora.dense_rows(corpora.read_dense_csv(spark, str(tmp_path / "a.csv"), 2)).collect()
    assert [(r.label, r.features) for r in rows] == [(1.0, [1.0, 2.0]), (0.0, [3.0, 4.0]), (0.0, [5.0, 6.0])]
    (tmp_path / "b.csv").write_text("label,v1,v2\np,1,oops\n")
    with pytest.raises(Exception):
        corpora.dense_rows(corpora.read_dense_csv(spark, str(tmp_path / "b.csv"), 2)).collect()


def test_long_stopword_list_on_any_columns(spark, monkeypatch):
    rows = [(1, 0, ["a", "b"]), (1, 1, ["b", "c"]), (1, 1, ["b", "c"]), (2, 0, None), (2, 1, ["b"])]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, tokens array<string>")
    stop = spark.createDataFrame([(f"s{i}",) for i in range(25_000)] + [("b",)], "token string")
    long = corpus.remove_stopwords(turns, stop)
    short = corpus.remove_stopwords(turns, stop.where("token = 'b'"))
    canonical = lambda df: sorted(map(str, df.collect()))
    assert canonical(long) == canonical(short)


def test_ids_of_two_files_differ(spark, tmp_path):
    for name in ("pos", "neg"):
        (tmp_path / f"{name}.json").write_text('[["a"],["b","c"]]')
    ids = [r.doc_id for n in ("pos", "neg") for r in corpora.read_json_corpus(spark, str(tmp_path / f"{n}.json"), n, across_files=True).collect()]
    assert len(set(ids)) == 4 and ids[1] == ids[0] + 1


def test_segmentation_keeps_rows_apart_without_a_key(spark, monkeypatch):
    lexicon = spark.createDataFrame([("國家", "n"), ("需要", "m"), ("正面", None)], "token string, flag string")
    rows = [(1, 1, "國家更需要正面"), (1, 2, "正面，國家"), (1, 2, "正面，國家"), (2, 1, None), (None, 1, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    plan = segment.segmented(df, lexicon, flags=["m"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan

    def got():
        found = segment.segmented(df, lexicon, flags=["m"]).collect()
        return sorted((r.conv_id or 0, r.turn, tuple(r.tokens)) for r in found)

    near = got()
    assert near == [(0, 1, ()), (1, 1, ("國家", "正面")), (1, 2, ("正面", "國家")), (1, 2, ("正面", "國家")), (2, 1, ())]
    monkeypatch.setattr(segment, "LEXICON_BROADCAST", 0)
    assert got() == near
