"""The training-data operators against brute force, and on nulls, empty texts, ties, empty tables and clashing columns."""

import hashlib
import random
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

import corpus_pipeline
from tonegrid.llm import chat, decontaminate, html, near_dup, packing, quality, sharding, suffix_dedup, tokens, urls

BPE = public_tokenizers.path("word_bpe_49k.json")
DOC = "doc_id long, text string, lang string, source string, n_chars long, kept string, spans string, length long"


def texts(seed=1, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["Éà", "naïve", "x#y"]
    base = [" ".join(rng.choices(words, k=rng.randint(5, 150))) for _ in range(n)]
    passage = " ".join(rng.choices(words, k=60))
    base += [base[3], base[4] + " tail", base[5].replace(" ", "\n", 1), passage + " " + base[6], base[7] + " " + passage]
    many = base[8].split()
    base += [" ".join([*many[:i], "edit", *many[i + 1 :]]) for i in range(len(many) - 4, len(many))]
    return base + ["", None, "short", "a " * 300, "aaaa" * 200]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 3 else None, "s" if i % 2 else None, 1, "c", "s", 2) for i, t in enumerate(texts())]
    rows += [(None, "null id text " * 20, "en", "s", None, None, None, None), (5, texts()[5], "en", "s", 1, None, None, 1)]
    rows += [(5, texts()[5], "en", "s", 1, None, None, 1), (5, "other text of a repeated id", None, None, 1, None, None, 1)]
    return spark.createDataFrame(rows, DOC).repartition(3).persist()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def ordered(docs):
    """Rows in the order that keys follow: NULL ids first, then id and text."""
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))


def test_token_counts_equal_the_tokenizer(docs, empty):
    vocabulary, unknown = tokens.read_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    real = Tokenizer(models.Unigram(vocabulary, unknown, True))
    real.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    out = tokens.counted(docs, public_tokenizers.path("piece_bpe_32k.model"))
    for r in out.collect():
        assert r.n_tokens == len(real.encode(r.text or "", add_special_tokens=False).ids), r.text
    odd = ["  two  blanks ", "\u4e00\U0001f600\n\ttab", " ", "e\u0301"]
    count = tokens.Counter(vocabulary)
    assert [sum(map(count, tokens.words(t))) for t in odd] == [len(real.encode(t).ids) for t in odd]
    assert tokens.counted(empty, public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def test_token_counts_tie_rule():
    vocabulary = [("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("aa", -2.0), ("▁a", -2.0)]
    real = Tokenizer(models.Unigram(vocabulary, 0, False))
    count = tokens.Counter(vocabulary)
    for word in ("▁a", "▁aa", "▁aaa", "▁aaaaa"):
        assert count(word) == len(real.encode(word).ids)


def test_plan_is_best_fit():
    rng = random.Random(3)
    lengths = [rng.randint(1, 100) for _ in range(500)] + [100] * 7 + [1] * 50
    counts = {n: lengths.count(n) for n in set(lengths)}
    rows = packing.plan(counts, 100)
    fill: dict[int, list] = {}
    for length, _, n, first, offset in rows.tolist():
        for k in range(n):
            fill.setdefault(first + k, []).append((offset, length))
    assert {n: sum(r[2] for r in rows.tolist() if r[0] == n) for n in counts} == counts
    for own in fill.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 100
    free: list[int] = []  # one piece at a time
    for n in sorted(lengths, reverse=True):
        fits = [r for r in free if r >= n]
        if fits:
            free.remove(min(fits))
        free.append((min(fits) if fits else 100) - n)
    assert len(fill) == len(free)
    assert packing.plan({}, 100).shape == (0, 5)


def test_packing(docs, empty):
    tokenizer = Tokenizer.from_file(BPE)
    out = packing.pack_documents(docs, BPE, 64).toPandas()
    want = []
    for doc_id, text in ordered(docs):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(doc_id, k // 64, k, len(ids[k : k + 64]), zlib.crc32(ids[k : k + 64].tobytes())) for k in range(0, len(ids), 64)]
    got = out[["doc_id", "piece", "start", "length", "ids_crc32"]].fillna(-1).astype(int)
    assert sorted(got.itertuples(index=False, name=None)) == sorted((-1 if d is None else d, *r) for d, *r in want)
    for _, own in out.sort_values("offset").groupby("sequence_id"):
        assert own["offset"].tolist() == [0, *own["length"].cumsum().tolist()[:-1]] and own["length"].sum() <= 64
    assert packing.pack_documents(empty, BPE).count() == 0


def test_special_strings_are_encoded_as_the_tokenizer_does(spark):
    rows = spark.createDataFrame([(1, "A<|endoftext|>b  c's e\u0301 \u0130")], "doc_id long, text string")
    ids = rows.select(packing.tokenized(F.col("text").cast("binary"), BPE, ids=True).alias("i")).first().i
    assert ids == [*Tokenizer.from_file(BPE).encode(rows.first().text, add_special_tokens=False).ids, 1]


def test_runs_are_cut_as_the_tokenizer_does():
    """Random strings of letters, marks, blanks, composing and special characters; a memory that forgets all the time."""
    real, rng = Tokenizer.from_file(BPE), random.Random(1)
    memo = packing.Ids(BPE, limit=20_000)
    alphabet = list("aAbsStTrReEvVmMlLdD'’.,;!?-_*#<|>1 2\t\n") + ["é", "É", "ß", "ñ", "ſ", "ŉ", "Ǆ", "ĳ", "÷", "×", "“", "…", "–", "²", "ª", "µ", "İ", "ı", "Σ", "ς"]
    alphabet += ["國", "\u0301", "\u0338", "\x1c", "\x00", "\x85", "\xa0", "\u2003", "\u200b", "K", "😀", "ﬁ", "'s", "'re", "<|endoftext|>", "<|ENDOFTEXT|>", "École"]
    for _ in range(5000):
        text = "".join(rng.choices(alphabet, k=rng.randint(1, 14)))
        assert np.frombuffer(memo.of(text.encode()), "<u4").tolist() == real.encode(text, add_special_tokens=False).ids, text


def test_memory_of_runs_is_bounded_in_bytes():
    """Text without a blank, and many long runs: the memory stays below its two generations."""
    real = Tokenizer.from_file(BPE)
    memo = packing.Ids(BPE, limit=200_000)
    long = "ab.c1" * 200_000  # 1 MB, one run
    assert np.frombuffer(memo.of(long.encode()), "<u4").tolist() == real.encode(long, add_special_tokens=False).ids
    for i in range(200):
        memo.of(" ".join(f"{i}-{k}-" + "x" * 100 for k in range(50)).encode())
    held = sum(len(k) + len(v) for part in (memo.young, memo.old) for k, v in part.items())
    assert held < 2 * 200_000 + 50_000 and max(map(len, memo.young)) <= memo.LONG


def test_sharding(docs, empty):
    out = sharding.shard_documents(docs).toPandas()
    assert len(out) == docs.count() and (out["size"] >= 1).all()
    sizes = out.groupby("shard")["size"].sum()
    assert sizes.max() - sizes.min() <= 2 * out["size"].max() + 200
    for _, own in out.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
    assert sharding.shard_documents(empty).count() == 0


def test_sharding_cuts_a_hot_group(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot " * 20).otherwise(F.repeat(F.md5(F.col("id").cast("string")), 2)).alias("text"))
    out = sharding.shard_documents(rows).toPandas()
    sizes = out.groupby("shard")["size"].sum()
    assert len(sizes) == 16 and sizes.max() / sizes.min() < 1.1
    assert out.merge(rows.toPandas(), on="doc_id").groupby("text")["shard"].nunique().drop("hot " * 20).max() == 1


def test_chat_escapes_reversibly():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choices(["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "/s>", "[", "x", "\n"], k=8))
        assert chat.unescape(chat.escape(text)) == text and not chat._CONTROL.search(chat.escape(text))
        assert chat.parse(chat.render(text, text)) == [(text, text)]


def test_chat_folds_events(spark):
    log = [
        (1, 1, 1, "open", "user", ""), (1, 1, 2, "delta", None, "he"), (1, 1, 3, "delta", None, "llo"),
        (1, 2, 4, "open", "assistant", None), (1, 2, 5, "delta", None, "bad"), (1, 2, 6, "regenerate", None, None),
        (1, 2, 7, "delta", None, "good"), (1, 1, 8, "edit", None, "bye"), (1, 1, 9, "delta", None, "!"),
        (1, 3, 10, "open", "user", "gone"), (1, 3, 11, "delete", None, None), (None, 1, 1, "delta", None, "lost"),
    ]
    events = spark.createDataFrame(log, "conv_id long, message_id long, seq long, kind string, role string, text string")
    got = {(r.conv_id, r.message_id): (r.role, r.text) for r in chat.fold(events).collect()}
    assert got == {(1, 1): ("user", "bye!"), (1, 2): ("assistant", "good"), (None, 1): ("", "lost")}


def test_chat_digests(spark):
    rows = [(1, 0, "user", "a" * 900), (1, 1, "assistant", None), (1, 1, "assistant", None), (1, 1, "assistant", "<s>\\"), (None, None, None, "x"), (2, 5, "tool", "t")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.formatted_turns(chat.fold(chat.as_events(turns)))).collect()}
    assert {k: r.n_turns for k, r in got.items()} == {1: 4, None: 1, 2: 1}
    want = f"user\n{'a' * 900}\nassistant\n\nassistant\n\nassistant\n<s>\\\n"
    assert got[1].turns_sha256 == hashlib.sha256(want.encode()).hexdigest()
    assert (got[1].loss_chars, got[1].loss_sha256) == (4, hashlib.sha256(b"<s>\\").hexdigest())
    assert chat.read_back(chat.formatted_turns(chat.fold(chat.as_events(turns.limit(0))))).count() == 0


def test_chat_cuts_long_messages_in_one_walk(spark):
    """Characters beyond the basic plane count once; 8 MB take no more than some seconds a MB."""
    import time

    text = ("é😀\n" * 700 + "x") * 3
    rows = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", "")], "conv_id long, turn long, role string, text string")
    deltas = chat.as_events(rows).where("kind = 'delta'").orderBy("seq").collect()
    assert [d.text for d in deltas] == [*[text[i : i + 400] for i in range(0, len(text), 400)], ""]
    long = spark.range(1).selectExpr("id conv_id", "0L turn", "'assistant' role", "repeat('0123456789', 800000) text")
    start = time.time()
    row = chat.read_back(chat.formatted_turns(chat.fold(chat.as_events(long)))).first()
    assert row.loss_chars == 8_000_000 and time.time() - start < 60
    assert row.loss_sha256 == hashlib.sha256(b"0123456789" * 800_000).hexdigest()


def slow_measure(text):
    words, dup = text.encode().split(), 0
    seen = set()
    for line in text.split("\n"):
        if line.encode().split():
            dup += line in seen
        seen.add(line)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)}
    return len(words), sum(len(w.decode()) for w in words), sum(text.count(c) for c in "#*$%&|<>"), dup, len(hit)


def test_quality_measures():
    for text in [t or "" for t in texts()] + ["a\n\n \na\nb a\n", "\x1c\x85 \u00a0x"]:
        m = quality.measure(text.encode())
        assert (*m[:3], *m[4:]) == slow_measure(text)


def test_quality_verdicts(spark, docs, empty):
    good = [(i, " ".join(f"word{random.Random(i * 50 + k).randint(0, 999)}" for k in range(40)), "en", "a") for i in range(150)]
    junk = [(200 + i, t.replace(" ", "### "), lang, s) for i, (_, t, lang, s) in enumerate(good[:9])]
    rows = spark.createDataFrame(good + junk + [(300, None, None, None)], "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in quality.filter_documents(rows).collect()}
    assert kept == set(range(150))
    assert quality.filter_documents(docs).columns == docs.columns and quality.filter_documents(empty).count() == 0


def test_quality_limits_hold_in_junk_sources(spark):
    rng = random.Random(8)

    def text(kind):
        if kind == "lines":
            return "\n".join(rng.choices([f"line{i}" for i in range(10)], k=40))
        return (" " if kind == "good" else "### ").join(f"word{rng.randint(0, 999)}" for _ in range(40))

    rows = []
    for source, junk, share, n in [("a", "symbols", 0, 120), ("b", "symbols", 0, 120), ("c", "symbols", 0, 120), ("s30", "symbols", 30, 400), ("s90", "symbols", 90, 900), ("d40", "lines", 40, 200)]:
        rows += [(kind, text(kind), "en", source) for kind in (junk if 100 * i < share * n else "good" for i in range(n))]
    table = spark.createDataFrame(rows, "kind string, text string, lang string, source string")
    kept = quality.filter_documents(table).groupBy("kind").count().collect()
    assert [tuple(r) for r in kept] == [("good", sum(r[0] == "good" for r in rows))]


def test_quality_keeps_honest_sources(spark):
    """A source that is symbol-rich throughout, narrowly or widely, keeps its documents; so does one with long words."""
    rng = random.Random(9)

    def text(share):
        return " ".join(rng.choice(["#", "|", "{}$"]) if rng.random() < share else f"word{rng.randint(0, 999)}" for _ in range(200))

    rows = [(text(0.0), "en", f"plain{i % 3}") for i in range(450)]
    rows += [(text(0.4), "en", "narrow") for _ in range(150)]
    rows += [(text(0.4 * rng.random()), "en", "wide") for _ in range(400)]
    table = spark.createDataFrame(rows, "text string, lang string, source string")
    kept = {r.source: r["count"] for r in quality.filter_documents(table).groupBy("source").count().collect()}
    assert kept == {"plain0": 150, "plain1": 150, "plain2": 150, "narrow": 150, "wide": 400}


def test_quality_ties_repeats_and_clashes(spark):
    """Values equal to a limit pass; repeated rows share a verdict; columns named like measures stay; long texts are whole."""
    fine = " ".join(f"word{i}" for i in range(40))
    rows = [(fine, "en", "s", 7, "m")] * 300 + [("#" * 3000, "en", "s", 8, "m")] * 5 + [(" ".join(f"x{i}" for i in range(400_000)), "en", "s", 9, "m")]
    table = spark.createDataFrame(rows, "text string, lang string, source string, n_words long, symbol_rate string")
    out = quality.filter_documents(table)
    assert out.columns == table.columns and {r.n_words: r["count"] for r in out.groupBy("n_words").count().collect()} == {7: 300, 9: 1}
    narrow = quality.measured(table)
    limits = quality.limits_of(narrow)
    high = limits.first().high_symbol_rate
    assert high == 60
    edge = spark.createDataFrame([("a" * 47 + " " + "b c d e f g h i " + "#" * 4 + "j", n) for n in (1, 2)], "text string, n long")
    edge = quality.measured(edge.selectExpr("text", "'en' lang", "'s' source"))
    assert {r["__m"].n_symbols * 1000 // r["__m"].word_chars for r in edge.collect()} == {66}
    exact = limits.withColumn("high_symbol_rate", F.lit(66).cast("long")).withColumn("low_word_length", F.lit(0).cast("long"))
    assert [r["__kept"] for r in quality.judged(edge, exact).collect()] == [True, True]
    assert [r["__kept"] for r in quality.judged(edge, exact.withColumn("high_symbol_rate", F.lit(65).cast("long"))).collect()] == [False, False]


def test_quality_measures_once(spark, docs):
    """The pipeline's stage reads stored measures: no Python, and no text, goes with the verdict by language and source."""
    plan = corpus_pipeline.quality_rules(spark, docs, "")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "Exchange hashpartitioning(" not in plan
    far = quality.filter_documents(docs, broadcast_rows=0)
    plan = far._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():
        assert not ("Exchange hashpartitioning(" in line and "source" in line and "text" in line)
    near = corpus_pipeline.quality_rules(spark, docs, "")
    assert sorted(map(str, far.collect())) == sorted(map(str, near.collect()))


def test_quality_sketch_merges_exactly(spark):
    values = spark.range(5000).select(F.lit("g").alias("g"), F.expr("(id * 7919) % 100003").alias("symbol_rate"), F.col("id").alias("dup_line_rate"), F.col("id").alias("word_length"))
    whole = quality.sketches(values, ["g"])
    halves = quality.sketches(values.where("symbol_rate % 2 = 0"), ["g"]).union(quality.sketches(values.where("symbol_rate % 2 = 1"), ["g"]))
    assert sorted(map(tuple, quality.merged(halves, ["g"]).collect())) == sorted(map(tuple, whole.collect()))
    for value, bucket in values.select("symbol_rate", quality.bucket(F.col("symbol_rate"))).collect():
        assert bucket <= value <= bucket * 1.01 + (value < 256) * 0


def test_decontamination(spark, docs, empty):
    rng = random.Random(9)
    all_texts = texts()
    items = [(1, " ".join(all_texts[10].split()[3:18])), (2, all_texts[11].upper()), (3, "w1 w2"), (4, ""), (5, None), (None, "w7 w9 w7")]
    items += [(6, " ".join(rng.choices([f"w{i}" for i in range(400)], k=30))), (2, all_texts[12])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows: dict = {}
    for item, text in items:
        own = decontaminate.words((text or "").encode())
        size = min(10, len(own))
        for k in range(len(own) - size + 1 if own else 0):
            windows.setdefault(tuple(own[k : k + size]), set()).add("" if item is None else str(item))
    for limit in (10**6, 25):  # one pass, several passes
        for r in decontaminate.searched(docs, bench, block_words=limit).collect():
            own = decontaminate.words((r.text or "").encode())
            hit, found = set(), set()
            for size in {len(w) for w in windows}:
                for k in range(len(own) - size + 1):
                    if names := windows.get(tuple(own[k : k + size])):
                        hit |= set(range(k, k + size))
                        found |= names
            assert (r["__n_words"], r["__n_hit"], r["__items"]) == (len(own), len(hit), sorted(found))
    best = decontaminate.searched(docs.where("doc_id = 10"), bench).first()["__matches"]
    assert max(m.length for m in best if m.item_id == "1") == 15
    assert decontaminate.drop_contaminated(docs, bench.limit(0)).count() == docs.count()
    assert decontaminate.drop_contaminated(empty, bench).count() == 0


def test_html_wrappers(spark, docs):
    page = '<html><head><title>T</title><script>var a="</p><article>"</script></head><body><header>H</header><nav><ul><li>m<li>n</ul></nav><div class="cookie-notice">c</div>{}<aside>s</aside><footer>f</footer></body></html>'
    main = "<article><h1>A &amp; B</h1><p>one\n <b>two</b><br>three<p>four<div class=comments><p>nasty</p></div><form>q</form><!-- c --><p>&lt;end&gt;</article>"
    rows = [(1, "http://a.com/x", page.format(main)), (2, "http://a.com/y", page.format(main.replace("</article>", ""))), (3, None, None), (4, "http://b.com", ""), (5, "x", "<p>only &eacute;</p> text"), (1, "http://a.com/x", page.format(main))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1))
    got = sorted((r.page_id, r.text) for r in html.main_text(pages).collect())
    want = "A & B\none two three\nfour\n<end>"
    assert got == [(1, want), (1, want), (2, want), (3, ""), (4, ""), (5, "only é\ntext")]
    assert html.main_text(pages.limit(0)).count() == 0


def test_html_inference():
    a = html.stream("<body><ul><li>1</li><li>2</li></ul><p>x</p></body>")
    b = html.stream("<body><ul><li>1</li><li>2</li><li>3</li></ul><div>ad</div><p>x</p><p>y</p></body>")
    assert "(<li> # </li>)+" in a
    both = html.align(a, b)
    assert html.align(both, a) == html.align(both, b) == both


def test_html_regions_hold_no_main_text():
    main = '<article><div class="article-header"><h1>one</h1></div><p class="notice">two</p><section class="related-work">three</section><div class="social-share">s</div><div class="x comments">c</div></article>'
    for page in ('<body class="has-sidebar">{}</body>', '<div class="page with-sidebar">{}</div>', '<div class="login-form-page">{}</div>', '<html class=login><body id="search">{}</body></html>', '<div class="widget">{}</div>', "<form>{}</form>"):
        assert html.extract(page.format(main), "<article>") == "one\ntwo\nthree", page
    # a teaser in a region is not the main text where there is one outside
    assert html.extract(f"<nav><article>teaser</article></nav>{main}<aside><article>teaser</article></aside>", "<article>") == "one\ntwo\nthree"
    page = '<main id="post-with-comments"><p>one</p><div id="comments">c</div></main>'
    assert html.extract(page, '<main id=post-with-comments>') == "one"


def test_html_raw_elements_end():
    for raw in ('<svg width="1"/>', "<object data=a />", "<button>x", "<select><option>x<option>y", "<svg><path d=1>", "<canvas>x", "<noscript>", "<iframe src=x>"):
        for page in (f"<body>{raw}<article><p>one</p><p>two</p></article></body>", f"<body><article><p>one{raw}</p><p>two</p></article><svg></svg></body>"):
            assert html.extract(page, "<article>") == "one\ntwo", page
    page = "<article><button>x<p>one</p><button>y</button><select-box>two</select-box><span>t<svg><path></span>hree<svg><title>x</title><svg></svg>y</svg></article>"
    assert html.extract(page, "<article>") == "one\ntwo\nthree"
    assert html.extract("<article>one<script>two</article>", "<article>") == "one"


def brute_repeats(rows):
    seen, out = set(), []
    for _, text in rows:
        b = (text or "").encode()
        hit = np.zeros(len(b), bool)
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                hit[s : s + 100] = True
            seen.add(b[s : s + 100])
        rest = bytes(x for x, h in zip(b, hit) if not h)
        runs = int((np.diff(np.r_[0, hit.astype(int)]) == 1).sum())
        out.append((len(b), int(hit.sum()), runs, hashlib.sha256(rest).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("shard", [2 << 20, 500])
def test_suffix_dedup(docs, empty, shard):
    out = suffix_dedup.deduplicated(docs, shard).select("__bytes", "__cut.n_removed", "__cut.n_spans", F.sha2("__cut.kept", 256))
    assert sorted(tuple(r) for r in out.collect()) == brute_repeats(ordered(docs))
    assert suffix_dedup.deduplicated(empty).count() == 0


def test_suffix_array_orders_and_prefixes():
    rng = random.Random(4)
    segments = [bytes(rng.choices(b"ab", k=rng.randint(1, 300))) for _ in range(20)]
    data = np.frombuffer(b"\xff".join([*segments, b""]), np.uint8)
    order, spot = suffix_dedup.suffix_array(data)
    raw = data.tobytes()
    head = [raw[p : p + 100] for p in order]
    assert head == sorted(head) and (order[spot] == np.arange(len(data))).all()


def test_near_duplicates(docs, empty):
    rows = ordered(docs)
    sets = []
    for _, t in rows:
        w = (t or "").encode().translate(near_dup.LOWER).split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    out = near_dup.near_duplicates(docs)
    order = {k: i for i, k in enumerate(sorted(r["__key"] for r in out.select("__key").collect()))}
    got = sorted((order[r["__key"]], r.n_shingles, order[r["root"]]) for r in out.collect())
    assert got == [(i, len(s), root[i]) for i, s in enumerate(sets)]
    assert near_dup.drop_near_duplicates(docs).count() == len(set(root))
    assert near_dup.drop_near_duplicates(empty).count() == 0


def test_near_duplicates_in_blocks(spark):
    base = [f"t{i}" for i in range(200)]
    rows = [(i, " ".join([*base[: i % 190], f"e{i}", *base[i % 190 + 1 :]])) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keyed = docs.select(F.col("doc_id").alias("__key"), F.col("text").cast("binary").alias("__text"))
    out = near_dup.clustered(keyed, block=40).select("root").distinct().collect()
    assert [r.root for r in out] == [0]


def test_near_duplicates_across_blocks(spark):
    """A family of three-quarter likeness, far larger than a block, and what it was made from, which links them all."""
    rng = random.Random(3)
    base = [f"t{i}" for i in range(200)]

    def edited(words, n, tag):
        out = list(words)
        for k, at in enumerate(rng.sample(range(5, 195), n)):
            out[at] = f"{tag}-{k}"
        return out

    family = [base] + [edited(base, 3, f"m{i}") for i in range(500)]
    family += [edited(family[i], 6, f"c{i}") for i in range(1, 20)]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in family]
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    rows = [(i, " ".join(w).encode()) for i, w in enumerate(family)]
    keyed = spark.createDataFrame(rows, "__key long, __text binary")
    got = {r["__key"]: r.root for r in near_dup.clustered(keyed, block=40).collect()}
    assert root.count(0) > 450 and [got[i] for i in range(len(root))] == root


def test_near_duplicates_thresholds(spark):
    """A copy 0.82 alike goes in the pipeline's stage and stays in op9."""
    assert [(near_dup.band_rows(x), near_dup.most_bits(x)) for x in (85, 80)] == [(5, 58), (4, 68)]
    words = [f"w{i}" for i in range(300)]
    copy = [f"x{i}" if i % 50 == 20 else w for i, w in enumerate(words)]  # 266 of 326 shingles
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(copy))], "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()] == [1]
    assert near_dup.drop_near_duplicates(docs).count() == 2


def test_url_parts_and_rules(spark):
    rows = [(1, "HTTP://A.Example.ORG/es/x?q#f"), (2, "https://example.org/en/1"), (3, "x.com/fr/"), (4, None), (5, "http://b.com/fr/?a"), (6, "s://notorg/"), (7, "u://org"), (8, "v://org/a\nb#c"), (9, "w://z.com?/de/")]
    out = urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit(1)))
    got = {r["__page"].page_id: (r.host, r.path, r.rule) for r in out.collect()}
    assert got == {
        1: ("a.example.org", "/es/x", "example.org/es/"), 2: ("example.org", "/en/1", "example.org/en/1"), 3: ("", "", None), 4: ("", "", None),
        5: ("b.com", "/fr/", "com/fr/"), 6: ("notorg", "/", None), 7: ("org", "", None), 8: ("org", "/a\nb", "org/"), 9: ("z.com", "", None),
    }
    assert {r.verdict for r in out.collect()} <= {"allow", "block"}
    none = spark.createDataFrame([(1, None)], "page_id long, url string")
    assert urls.filter_urls(none).first().verdict == "allow" and urls.filter_urls(none.limit(0)).count() == 0


def test_url_trees_learn_held_out(spark):
    rng = random.Random(5)
    rows = []
    for i in range(1200):
        bad = rng.random() < 0.5
        host = f"{'cheap-win-' if bad else ''}{rng.choice('abcdef')}.com"
        rows.append((f"http://{host}/{rng.randint(10**6, 10**9) if bad else 'page'}", host, "/x", "block" if bad else "allow"))
    data = spark.createDataFrame(rows, "url string, host string, path string, label string")
    out = urls.UrlModel(data.limit(800), trees=5).judge(data)
    assert out.where("label = __method").count() / 1200 > 0.95


def test_url_sample_is_bounded(spark, monkeypatch):
    """A URL that most labelled rows repeat is one row of the sample."""
    hot = spark.range(3000).select(F.lit("http://h.com/").alias("url"), F.lit("h.com").alias("host"))
    rest = spark.range(2000).select(F.format_string("http://h%d.com/", "id").alias("url"), F.format_string("h%d.com", "id").alias("host"))
    label = F.when(F.xxhash64("url") % 3 == 0, "block").otherwise("allow")
    drawn = []
    lexical = urls.lexical
    monkeypatch.setattr(urls, "lexical", lambda df: drawn.append(df.count()) or lexical(df))
    urls.UrlModel(hot.union(rest).select("url", "host", F.lit("/").alias("path"), label.alias("label")), sample=500, trees=1)
    assert 350 < drawn[0] < 650


def test_pipeline_stages(spark, docs, empty):
    import os
    import tempfile

    folder = tempfile.mkdtemp(prefix="pipeline-")
    spark.createDataFrame([(1, texts()[20])], "item_id long, text string").write.parquet(os.path.join(folder, "benchmark.parquet"))
    for start in (docs, empty):
        own = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            own = stage(spark, own, folder)
            assert own.columns == docs.columns
            own = own.persist()
            own.count()
        last = corpus_pipeline.STAGES[-1][1](spark, own, folder)
        assert {"doc_id", "sequence_id", "offset"} <= set(last.columns)
        assert (last.count() > 0) == (start is docs)


def test_suffix_order_breaks_ties_by_place(monkeypatch):
    """Packed or not, suffixes that agree on more bytes than a string has stay in text order, as the prefixes need."""
    rng = np.random.default_rng(4)
    data = np.tile(rng.integers(97, 100, 300, dtype=np.uint8), 5)
    order, spot = suffix_dedup.suffix_array(data)
    plain = sorted(range(len(data)), key=lambda p: (bytes(data[p : p + 128]), p))
    assert order.tolist() == plain and spot[order].tolist() == list(range(len(data)))
    monkeypatch.setattr(suffix_dedup, "PACKED", 1)
    assert suffix_dedup.suffix_array(data)[0].tolist() == plain


def test_repeats_are_cut_by_one_worker_a_task(spark):
    text = "".join(hashlib.sha256(b"%d" % i).hexdigest() for i in range(5))[:300]
    docs = spark.createDataFrame([(1, text, 300), (2, text, 300), (3, None, None), (4, "é" + text[:150] + "ü", 152)], "doc_id long, text string, n_chars long")
    out = suffix_dedup.drop_repeats(docs)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert got == {1: (text, 300), 3: (None, None), 4: ("éü", 2)}


def test_intermediates_take_little_disk(spark):
    """Anchor runs are dealt without being stored, and near duplicates leave neither texts nor blocks behind."""
    import os

    root = spark.conf.get("spark.checkpoint.dir")

    def left(work):
        before = set(os.listdir(root))
        rows = work().count()
        new = [os.path.join(at, f) for d in set(os.listdir(root)) - before for at, _, files in os.walk(os.path.join(root, d)) for f in files]
        return rows, sum(os.path.getsize(f) for f in new)

    long = [" ".join(hashlib.sha256(b"%d %d" % (i, j)).hexdigest() for j in range(300)) for i in range(30)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(long + [t + " tail" for t in long])], "doc_id long, text string").persist()
    size = sum(map(len, long)) * 2
    assert left(lambda: suffix_dedup.drop_repeats(docs.limit(30)))[0] == 30
    rows, kept = left(lambda: suffix_dedup.spans_to_remove(docs.where("doc_id < 30").select(F.col("doc_id").alias("__key"), F.col("text").cast("binary").alias("__text"))))
    assert rows == 0 and kept < size / 20
    rows, kept = left(lambda: near_dup.drop_near_duplicates(docs))
    assert rows == 30 and kept < size / 4
