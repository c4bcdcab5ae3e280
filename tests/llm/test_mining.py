"""Collocations, nearest vectors and centroid clustering against brute force, and on odd inputs."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonegrid.llm import ann, centroids, phrases

NAN, INF = float("nan"), float("inf")


def brute_phrases(rows, least, longest, top):
    count, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    count[lang, tuple(words[i : i + k])] += 1
    often = {key: n for key, n in count.items() if n >= least}
    best: dict = {}
    for (lang, words), a in often.items():
        if len(words) < 2:
            continue
        cuts = [(1000 * a * total[lang] // (often[lang, words[:k]] * often[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        inside = lambda w: any(w[i : i + len(words)] == words for i in range(len(w) - len(words) + 1))  # noqa: B023, E731
        if any(other == lang and len(w) > len(words) and n >= a and inside(w) for (other, w), n in often.items()):
            continue
        best.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), often[lang, words[:k]], often[lang, words[k:]]))
    return sorted(
        (lang, rank, phrase.decode(), -a, left, right, total[lang], -score)
        for lang, found in best.items()
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1)
    )


def corpus(seed=4):
    rng = random.Random(seed)
    words = ["new", "York", "CITY", "of", "the", "é à", "x\x1cy", "#", "naïve", "İ"]
    rows = []
    for i in range(150):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", " "]) for _ in range(rng.randint(0, 60)))
        rows.append((text, rng.choice(["en", "fr", None, "und"])))
    return rows + [("", "en"), (None, None), (None, "de"), ("a " * 40, "en"), ("The new york city. " * 30, "fr")] * 3


@pytest.mark.parametrize("block", [1, 300, phrases.BLOCK])
def test_collocations(spark, monkeypatch, block):
    rows = corpus()
    docs = spark.createDataFrame([(t, lang, 1, "p") for t, lang in rows], "text string, lang string, n long, phrase string").repartition(5)
    for least, top in ((5, 2000), (12, 3)):
        got = [tuple(r) for r in phrases.collocations(docs, least, 5, top, block).collect()]
        assert sorted(got) == brute_phrases(rows, least, 5, top)


def test_collocations_of_long_texts(spark):
    """Texts longer than a slice: a phrase may lie across the cut, a word without blanks may be longer than a slice."""
    text = "alpha beta gamma " * (3 * phrases.SLICE // 17) + "x" * (2 * phrases.SLICE) + " alpha beta"
    assert b"".join(phrases.slices(text.encode())) == text.encode()
    docs = spark.createDataFrame([(text, "en"), (text[:1000], "en")], "text string, lang string")
    got = [tuple(r) for r in phrases.collocations(docs).collect()]
    assert sorted(got) == brute_phrases([(text, "en"), (text[:1000], "en")], 100, 5, 2000)


def test_collocations_of_nothing(spark):
    docs = spark.createDataFrame([(None, None), ("one two", "en")], "text string, lang string")
    assert phrases.collocations(docs).count() == 0 and phrases.collocations(docs.limit(0)).count() == 0


def test_exact_arithmetic_passes_64_bits(spark):
    row = [(10**14, 10**15, [10**14 + 1, 10**14], [10**14 + 7, 10**14])]
    one = spark.createDataFrame(row, "f long, n long, heads array<long>, tails array<long>").select(phrases.lowest_cut(2).alias("c")).first().c
    assert one.score == 1000 * 10**14 * 10**15 // ((10**14 + 1) * (10**14 + 7))


def test_packed_arrays():
    for values in ([], [0], [0, 255, 256, 2**40, 2**62], list(range(1000))):
        assert phrases.unpacked(phrases.packed(np.array(values, np.int64))).tolist() == values
    for refs in ([], [0], [1], [0, 1, 2, 0, 2, 1, 3, 0, 0, 4, 1], [1, 1, 2]):
        assert phrases.renumbered(phrases.numbered(np.array(refs, np.int64))).tolist() == refs


VECTORS = "vec_id long, embedding array<float>, query_id long, rank int, score double"


def vectors(seed=1, n=400, dim=24):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.standard_normal(dim).astype("f4").tolist()) for i in range(n)]
    rows += [(n + i, rows[i % 3][1]) for i in range(60)]  # copies, more than are asked for
    rows += [(1000 + i, [2 * x for x in rows[i][1]]) for i in range(10)]  # equal directions
    rows += [(50, rows[7][1]), (100, rows[100][1]), (100, rows[100][1]), (None, rows[5][1])]  # repeated ids, an equal row
    rows += [(150, None), (200, [0.0] * dim), (250, [*rows[0][1][1:], NAN]), (300, [*rows[0][1][1:], INF]), (2000, [*rows[0][1][1:], None])]
    return rows + [(2050, []), (2100, [1.0]), (2150, [-1.0]), (2200, [3.0, 4.0]), (2251, [4.0, 3.0])]


def brute_nearest(rows, n):
    ok = [r for r in rows if r[0] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]
    out = []
    for k, (query, q) in enumerate(ok):
        if query % 50:
            continue
        found = []
        for i, (id_, v) in enumerate(ok):
            if i != k and len(v) == len(q):
                dot = norm_v = norm_q = 0.0
                for a, b in zip(v, q):
                    dot, norm_v, norm_q = dot + a * b, norm_v + a * a, norm_q + b * b
                found.append((-(dot / (math.sqrt(norm_v) * math.sqrt(norm_q))), id_))
        out += [(query, rank, id_, -score) for rank, (score, id_) in enumerate(sorted(found)[:n], 1)]
    return sorted(out)


@pytest.mark.parametrize("part", [40, ann.PART])
def test_nearest_vectors(spark, part):
    rows = vectors()
    table = spark.createDataFrame([(*r, 1, 2, 3.0) for r in rows], VECTORS).repartition(4)
    got = sorted(tuple(r) for r in ann.nearest_vectors(table.where("vec_id % 50 = 0"), table, part=part).collect())
    want = brute_nearest([(i, None if v is None else [x if x is None else float(np.float32(x)) for x in v]) for i, v in rows], 5)
    assert got == want
    assert ann.nearest_vectors(table.limit(0), table).count() == 0
    assert ann.nearest_vectors(table.where("vec_id = 0"), table.limit(0)).count() == 0


def test_error_bounds_hold():
    rng = np.random.default_rng(3)
    for dim in (3, 64, 300):
        unit = rng.standard_normal((500, dim))
        unit /= ann.norms(unit)[:, None]
        code, ones, fix, off = ann.encoded(unit)
        planes, scalars = ann.quantized(unit[:50])
        guess = ann.estimates(np.ascontiguousarray(code.T), ones, fix, planes, scalars)
        slack = ann.DEVIATIONS * np.sqrt(off[None, :] ** 2 + (scalars[:, 3:] * fix[None, :]) ** 2)
        true = unit[:50] @ unit.T
        assert (np.abs(guess - true) <= slack + 1e-9).mean() > 0.99, dim


def brute_clusters(rows, k, rounds, width):
    import hashlib

    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    seed = lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    cents = [list(v) for _, v in sorted(ok, key=seed)[:k]]
    dist = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    for r in range(rounds + 1):
        said = [min((dist(v, c), j) for j, c in enumerate(cents)) for _, v in ok]
        if r < rounds:
            for j in range(len(cents)):
                own = [v for (_, v), s in zip(ok, said) if s[1] == j]
                if own:
                    cents[j] = [sum(col) // len(own) for col in zip(*own)]
    return sorted((-1 if i is None else i, j, d) for (i, _), (d, j) in zip(ok, said)), cents


@pytest.mark.parametrize("block", [16, centroids.BLOCK])
def test_clustering(spark, block):
    rows = vectors(seed=2, n=150, dim=8)
    rows += [(3000 + i, [float(i % 2), -0.001, 1e-3] + [0.0] * 5) for i in range(9)]  # ties and repeats
    table = spark.createDataFrame([(*r, 1, 2, 3.0) for r in rows], VECTORS).repartition(4)
    for k in (7, 1000):
        got, cents = centroids.cluster(table, k, 3, 8, block=block)
        exact = [(i, None if v is None else [x if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
        want, expected = brute_clusters(exact, k, 3, 8)
        assert sorted((-1 if r.id is None else r.id, r.cluster, r.distance) for r in got.collect()) == want
        assert cents.tolist() == expected
    for none in (table.limit(0), table.where("embedding IS NULL")):
        got, cents = centroids.cluster(none, 7, 3, 8)
        assert got.count() == 0 and not len(cents)


def test_large_components_stay_in_range(spark):
    table = spark.createDataFrame([(1, [1e30, -1e30]), (2, [0.5, -0.25])], "vec_id long, embedding array<float>")
    got, cents = centroids.cluster(table, 2, 2, 2)
    assert got.where("distance = 0").count() == 2 and abs(cents).max() == centroids.LARGEST


def test_queries(spark):
    """The digest columns of the registered queries, on small tables."""
    import tempfile

    folder = tempfile.mkdtemp(prefix="tonegrid-tables-")
    rows = [(i, np.random.default_rng(i).standard_normal(64).astype("f4").tolist()) for i in range(120)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    texts = [(t, lang) for t, lang in corpus() for _ in range(4)]
    spark.createDataFrame(texts, "text string, lang string").withColumn("doc_id", F.lit(1)).write.parquet(f"{folder}/documents.parquet")
    assert sorted(tuple(r) for r in phrases.op11_collocations(spark, folder).collect()) == brute_phrases(texts, 100, 5, 2000)
    assert sorted(tuple(r) for r in ann.op12_nearest_vectors(spark, folder).collect()) == brute_nearest([(i, [float(x) for x in v]) for i, v in rows], 5)
    want, cents = brute_clusters(rows, 40, 5, 64)
    out = centroids.op13_centroid_clustering(spark, folder).collect()
    assert sorted((r.vec_id, r.cluster, r.distance) for r in out) == want
    inertia = Counter()
    for _, j, d in want:
        inertia[j] += d
    for r in out:
        assert (r.cluster_inertia, r.inertia) == (inertia[r.cluster], sum(inertia.values()))
        assert r.centroid_sha256 == centroids.digest(np.array(cents[r.cluster]))
    spark.range(0).select(F.lit(1).cast("long").alias("vec_id"), F.array(F.lit(1.0)).alias("embedding")).write.parquet(f"{folder}/none/embeddings.parquet")
    assert centroids.op13_centroid_clustering(spark, f"{folder}/none").count() == 0 == ann.op12_nearest_vectors(spark, f"{folder}/none").count()
