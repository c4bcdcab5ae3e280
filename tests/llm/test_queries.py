"""The registered queries themselves, on small Parquet tables, against brute force."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from test_llm import brute_repeats, slow_measure, texts
from tonegrid.llm import decontaminate, near_dup, packing, quality, sharding, suffix_dedup, urls

LINES = "\n".join(f"line {i % 4}" for i in range(30))


@pytest.fixture(scope="module")
def rows():
    return list(enumerate([*texts(), LINES, "x" * 50_000, "one two three"]))


@pytest.fixture(scope="module")
def items():
    own = texts()
    return [("b1", " ".join(own[10].split()[3:18])), ("a2", own[11].upper()), ("c3", "w1 w2"), ("d4", ""), ("e5", None), ("f6", own[12])]


@pytest.fixture(scope="module")
def urls_():
    rng = random.Random(6)
    hosts = ["a.example.org", "EXAMPLE.org", "x.com", "com", "notcom", "b.net", "org"]
    paths = ["", "/", "/es/", "/es/x", "/en/1", "/en/12", "/fr/a", "/de/b", "/de", "/fr?/de/", "/x#/de/"]
    fixed = [None, "", "no scheme", "://", "http://", "s://org/\n/x", "http://user@com/de/ é"]
    return fixed + [f"{rng.choice(['http', 'HTTPS'])}://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(200)]


@pytest.fixture(scope="module")
def folder(spark, rows, items, urls_, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    docs = [(i, t, "en" if i % 3 else None, f"s{i % 2}", 1) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame(list(enumerate(urls_)), "page_id long, url string").withColumn("html", F.lit("")).write.parquet(f"{at}/pages.parquet")
    return at


def test_op2(spark, rows, folder):
    real = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = packing.op2_packing(spark, folder).toPandas()
    want = []
    for i, text in rows:
        ids = np.array([*real.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(i, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes())) for k in range(0, len(ids), 4096)]
    assert sorted(out[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == sorted(want)
    for _, own in out.sort_values("offset").groupby("sequence_id"):
        assert own["offset"].tolist() == [0, *own["length"].cumsum().tolist()[:-1]] and own["length"].sum() <= 4096
    assert out["sequence_id"].nunique() == -(-int(out["length"].sum()) // 4096)


def test_op3(spark, rows, folder):
    out = sharding.op3_sharding(spark, folder).toPandas().set_index("doc_id")
    assert sorted(out.index) == [i for i, _ in rows] and out["shard"].between(0, 15).all() and out["law"].nunique() == 1
    for i, text in rows:
        assert out.loc[i, "size"] == len((text or "").encode()) + 1 and out.loc[i, "text_crc32"] == zlib.crc32((text or "").encode())
    for _, own in out.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))


def test_op5(spark, rows, folder):
    out = {r.doc_id: r for r in quality.op5_quality_rules(spark, folder).collect()}
    assert len(out) == len(rows)
    for i, text in rows:
        n, chars, symbols, dup, repeated = slow_measure(text or "")
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeated)
        assert r.base_failed == (n < 10 or 100 * repeated > 20 * n) and not (r.base_failed and r.kept)


def test_op6(spark, rows, items, folder):
    windows: dict = {}
    for item, text in items:
        own = decontaminate.words((text or "").encode())
        size = min(10, len(own))
        for k in range(len(own) - size + 1 if own else 0):
            windows.setdefault(tuple(own[k : k + size]), set()).add(item)
    out = {r.doc_id: r for r in decontaminate.op6_decontaminate(spark, folder).collect()}
    for i, text in rows:
        own, hit, found = decontaminate.words((text or "").encode()), set(), set()
        for size in {len(w) for w in windows}:
            for k in range(len(own) - size + 1):
                if names := windows.get(tuple(own[k : k + size])):
                    hit |= set(range(k, k + size))
                    found |= names
        r = out[i]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(own), len(hit), len(found), digest, bool(hit))
    assert any(r.contaminated for r in out.values())


def test_op8(spark, rows, folder):
    out = suffix_dedup.op8_suffix_dedup(spark, folder).collect()
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out) == brute_repeats(rows)
    assert sorted(r.doc_id for r in out) == [i for i, _ in rows]


def test_op9(spark, rows, folder):
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
    out = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dup.op9_near_dup(spark, folder).collect())
    assert out == [(i, len(s), root[i], root[i] == i) for i, s in enumerate(sets)]


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def test_op10(spark, urls_, folder):
    out = {r.page_id: r for r in urls.op10_url_filter(spark, folder).collect()}
    assert len(out) == len(urls_)
    for i, url in enumerate(urls_):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
        fits = [(h + p, said) for h, p, said in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, said = max(fits, key=lambda f: len(f[0]), default=(None, None))
        r = out[i]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block")
        assert said is None or r.verdict == said
