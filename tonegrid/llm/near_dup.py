"""Near duplicates on word shingles: MinHash bands, odd sketches, exact confirmation, components."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import union_all
from .common import discard, partitions, released, small_batches, stored, table, utf8, with_key
from .graph import components

SHINGLE = 5
SAMPLES = 100
#: Bits of an odd sketch.
BITS = 512
#: Links: 100 * intersection >= link * union. This is the link of op9; other callers give theirs.
LINK = 85
#: Odds that two documents at the link threshold share no band are below this.
MISSED = 1e-5
#: Documents of a bucket that are compared in one task; larger buckets are cut into blocks joined through their hubs, and
#: what that leaves apart is compared block by block.
BLOCK = 1500
HUBS = 16

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SEEDS = np.random.default_rng(20240607)
_FACTORS = _SEEDS.integers(1, 2**63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MASKS = _SEEDS.integers(0, 2**63, SAMPLES, dtype=np.uint64)
_WORD = np.uint64(0x9E3779B97F4A7C15)


def band_rows(link: int) -> int:
    """Samples of a band: as many as keep the odds of sharing no band under MISSED (5 at 0.85, in 20 bands; 4 at 0.80, in 25)."""
    return max(r for r in range(1, 11) if r == 1 or (1 - (link / 100) ** r) ** (SAMPLES // r) < MISSED)


def most_bits(link: int) -> int:
    """Two documents at the link threshold differ in at most this many sketch bits but for odds below one in a million.

    At 0.85, five standard deviations (0.036 each at 100 samples) down is 0.67, and the 66 parities of samples that
    differ set 58 bits; at 0.80 it is 0.60, 80 and 68.
    """
    differ = min(SAMPLES, math.ceil(SAMPLES - link + 5 * math.sqrt(SAMPLES * (link / 100) * (1 - link / 100))))
    return int(BITS / 2 * (1 - (1 - 2 / BITS) ** (2 * differ)))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA3B195354A39B70D)
    return h ^ (h >> np.uint64(32))


def shingles(text: bytes) -> np.ndarray:
    """The document's set: sorted 64-bit values of its distinct 5-word shingles, or of its whole shorter sequence."""
    words = text.translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    size = min(SHINGLE, len(words))
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    last = len(words) - size + 1
    out = np.full(last, size, np.uint64)
    for k in range(size):
        out = mix((out ^ hashed[k : k + last]) * _WORD)
    return np.unique(out)


def samples(values: np.ndarray) -> np.ndarray:
    """The MinHash sample: the least value under each of the permutations."""
    least = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(values), 2048):
        part = (values[None, at : at + 2048] ^ _MASKS[:, None]) * _FACTORS[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    return least


def odd_sketch(least: np.ndarray) -> bytes:
    """Parity bitmap of the sample: each (permutation, value) toggles one bit."""
    at = (mix(least + np.arange(1, SAMPLES + 1, dtype=np.uint64) * _WORD) % np.uint64(BITS)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=BITS) & 1).astype(np.uint8)).tobytes()


def band_keys(least: np.ndarray, link: int) -> np.ndarray:
    size = band_rows(link)
    bands = SAMPLES // size
    rows = least[: bands * size].reshape(bands, size)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(size):
        key = mix((key ^ rows[:, k]) * _WORD)
    return key.view(np.int64)


SIGNATURE = "__key long, n_shingles long, fp1 long, fp2 long, bands array<long>, sketch binary"


def _sign(batches: Iterator[pd.DataFrame], link: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for key, text in zip(batch["__key"], batch["__text"]):
            values = shingles(text)
            if not len(values):
                rows.append((key, 0, 0, 0, None, None))
                continue
            whole = [int(f) for f in (np.bitwise_xor.reduce(mix(values)).view(np.int64), mix(values * _WORD).sum(dtype=np.uint64).view(np.int64))]
            least = samples(values)
            rows.append((key, len(values), *whole, band_keys(least, link), odd_sketch(least)))
        yield pd.DataFrame(rows, columns=["__key", "n_shingles", "fp1", "fp2", "bands", "sketch"])


def signatures(docs: DataFrame, link: int = LINK) -> DataFrame:
    """Per row of ``docs`` (__key, __text): set size, set fingerprint, band keys and odd sketch."""
    small_batches(docs.sparkSession, mb=4)
    return docs.select("__key", "__text").mapInPandas(released(lambda batches: _sign(batches, link)), SIGNATURE)


def bits_apart(sketches: np.ndarray) -> np.ndarray:
    """Differing bits of every two sketches (rows of 64-bit words)."""
    n = len(sketches)
    out = np.zeros((n, n), np.uint16)
    for word in sketches.T:
        out += np.bitwise_count(word[:, None] ^ word[None, :])
    return out


def forest(apart: np.ndarray, most: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Edges of a spanning forest that prefers the most similar pairs (Boruvka rounds), and the tree of each row."""
    n = len(apart)
    tree, edges = np.arange(n), []
    while True:
        open_ = np.where(tree[:, None] == tree[None, :], 65535, apart)
        partner = open_.argmin(axis=1)
        value = open_[np.arange(n), partner]
        merged = False
        for i in np.lexsort((np.arange(n), value)):
            if value[i] > most:
                break
            a, b = tree[i], tree[partner[i]]
            if a != b:
                tree[tree == b] = a
                edges.append((int(i), int(partner[i])))
                merged = True
        if not merged:
            return edges, tree


def proposals(apart: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Further pairs worth confirming: a greedy cover by stars (each row with the first hub near it), the two nearest."""
    n = len(apart)
    near = apart <= most
    np.fill_diagonal(near, False)
    out = []
    left = near.any(axis=1)
    while left.any():
        hub = int((near & left[None, :]).sum(axis=1).argmax())
        reach = np.flatnonzero(near[hub] & left)
        out += [(hub, int(j)) for j in reach]
        left[reach] = False
        left[hub] = False
    others = np.where(near, apart, 65535)
    for _ in range(min(2, n - 1)):
        best = others.argmin(axis=1)
        out += [(i, int(j)) for i, j in enumerate(best) if others[i, j] <= most]
        others[np.arange(n), best] = 65535
    return out


CANDIDATE = "a long, b long, first boolean, hub long, bucket long"


def _block(keys: np.ndarray, sketches: np.ndarray, most: int) -> tuple[list[tuple], np.ndarray]:
    """Candidate pairs of one block, forest edges first, and the rows with most partners."""
    apart = bits_apart(sketches)
    chosen = {(min(p), max(p)) for p in forest(apart, most)[0]}
    rest = {(min(p), max(p)) for p in proposals(apart, most)} - chosen
    out = [(keys[i], keys[j], True) for i, j in chosen] + [(keys[i], keys[j], False) for i, j in rest]
    hubs = np.argsort(-(apart <= most).sum(axis=1), kind="stable")[:HUBS] if len(keys) > HUBS else np.arange(len(keys))
    return out, keys[hubs]


def _blocks(rows: pd.DataFrame, link: int) -> pd.DataFrame:
    """Candidates of whole blocks, sorted by (bucket, block, __key); buckets of two are compared all at once."""
    most = most_bits(link)
    keys, bucket, many = rows["__key"].to_numpy(), rows["bucket"].to_numpy(), rows["blocks"].to_numpy() > 1
    sketches = np.frombuffer(b"".join(rows["sketch"]), np.uint64).reshape(len(rows), -1)
    block = rows["block"].to_numpy()
    starts = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (block[1:] != block[:-1])])
    sizes = np.diff(np.r_[starts, len(rows)])
    two = starts[sizes == 2]
    near = np.bitwise_count(sketches[two] ^ sketches[two + 1]).sum(axis=1) <= most
    two_pairs = two[near]
    pairs = [(a, b, True) for a, b in zip(keys[two_pairs], keys[two_pairs + 1])]
    hubs: list[tuple] = []
    for at, size in zip(starts, sizes):
        if size > 2:
            found, central = _block(keys[at : at + size], sketches[at : at + size], most)
            pairs += found
        else:
            central = keys[at : at + size]
        if many[at]:
            hubs += [(hub, bucket[at]) for hub in central]
    out = [(*p, None, None) for p in pairs] + [(None, None, None, *h) for h in hubs]
    frame = pd.DataFrame(out, columns=["a", "b", "first", "hub", "bucket"])
    return frame.astype({"a": "Int64", "b": "Int64", "first": "boolean", "hub": "Int64", "bucket": "Int64"})


def shared_counts(left: list[np.ndarray], right: list[np.ndarray], width: int = 2048) -> np.ndarray:
    """Sizes of the intersections of every left with every right set, as products of 0/1 matrices ``width`` values wide."""
    out = np.zeros((len(left), len(right)), np.int64)
    sides = []
    for sets in (left, right):
        owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        sides.append((np.concatenate(sets) if sets else np.empty(0, np.uint64), owner))
    common = np.intersect1d(sides[0][0], sides[1][0])
    placed = []
    for flat, owner in sides:
        at = np.minimum(np.searchsorted(common, flat), max(0, len(common) - 1))
        hit = common[at] == flat if len(common) else np.zeros(len(flat), bool)
        at, owner = at[hit], owner[hit]
        by = np.argsort(at, kind="stable")
        placed.append((at[by], owner[by]))
    for low in range(0, len(common), width):
        cells = []
        for (at, owner), n in zip(placed, out.shape):
            some = slice(*np.searchsorted(at, [low, low + width]))
            cell = np.zeros((n, width), np.float32)  # sums stay below 2^24, so they are exact
            cell[owner[some], at[some] - low] = 1
            cells.append(cell)
        out += (cells[0] @ cells[1].T).astype(np.int64)
    return out


def _across(rows: pd.DataFrame, link: int) -> pd.DataFrame:
    """Links between rows of a task that lie in different components, found on their full sets.

    ``far`` rows are held against all near rows of other components; the rest of the task is one component. In a task of
    two groups (``part``) of far rows the groups are held against each other only. A link joins its components at once.
    No pair that is not a link leaves the task.
    """
    links = []
    for _, g in rows.groupby(["bucket", "block"], sort=False):
        keys, root = g["__key"].to_numpy(), np.unique(g["root"], return_inverse=True)[1]
        sketches = np.frombuffer(b"".join(g["sketch"]), np.uint64).reshape(len(g), -1)
        far, part = g["far"].to_numpy(), g["part"].to_numpy()
        left, right = np.flatnonzero(far), np.arange(len(g))
        if far.all() and part.min() < part.max():
            left, right = np.flatnonzero(part == part.min()), np.flatnonzero(part == part.max())
        apart = np.zeros((len(left), len(right)), np.uint16)
        for word in sketches.T:
            apart += np.bitwise_count(word[left][:, None] ^ word[right][None, :])
        near = (apart <= most_bits(link)) & (root[left][:, None] != root[right][None, :])
        rows_near, columns_near = near.any(axis=1), near.any(axis=0)
        left, right, near = left[rows_near], right[columns_near], near[np.ix_(rows_near, columns_near)]
        if not len(left):
            continue
        texts = g["__text"].to_numpy()
        sets = {i: shingles(texts[i]) for i in {*left.tolist(), *right.tolist()}}
        own, other = [sets[i] for i in left], [sets[j] for j in right]
        both = shared_counts(own, other)
        union = np.array([len(x) for x in own])[:, None] + np.array([len(x) for x in other])[None, :] - both
        for i, j in np.argwhere(near & (100 * both >= link * union)):
            i, j = left[i], right[j]
            if root[i] != root[j]:
                links.append((keys[i], keys[j]))
                root[root == root[i]] = root[j]
    return pd.DataFrame(links, columns=["u", "v"], dtype="int64")


def _per_block(batches: Iterator[pd.DataFrame], work: Callable[[pd.DataFrame], pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows arrive sorted by block; a block, at most about BLOCK rows, may span batches."""
    held = None
    for batch in batches:
        held = batch if held is None else pd.concat([held, batch], ignore_index=True)
        last = held[["bucket", "block"]].iloc[-1]
        open_ = (held["bucket"] == last["bucket"]) & (held["block"] == last["block"])
        if not open_.all():
            yield work(held[~open_])
        held = held[open_]
    if held is not None and len(held):
        yield work(held)


def _compared(rows: DataFrame, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``work`` on whole blocks of (bucket, block, __key, …)."""

    def by_block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _per_block(batches, work)

    dealt = rows.repartition("bucket", "block").sortWithinPartitions("bucket", "block", "__key")
    return dealt.mapInPandas(released(by_block), schema)


def candidates(signed: DataFrame, block: int = BLOCK, link: int = LINK) -> tuple[DataFrame, DataFrame]:
    """Pairs (a < b) that share a band and whose sketches are near, with ``first`` for forest edges; the blocks.

    Every row of ``signed`` has its own set. Buckets of over ``block`` rows are cut into blocks; the hubs of the
    blocks form buckets of their own in the next round (``of_hubs``), until each bucket is one block. Hubs only spare
    later work: ``left_over`` takes the pairs of all blocks.
    """
    bands = signed.select("__key", F.explode("bands").alias("bucket"))
    shared = bands.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    rows = bands.join(shared.hint("merge"), "bucket")
    found, kept = [], []
    while True:
        blocks = F.ceil(F.col("n") / F.lit(block))
        rows = rows.select("__key", "bucket", blocks.alias("blocks"))
        cut = F.pmod(F.xxhash64("__key", "bucket"), F.col("blocks"))
        rows = rows.join(signed.select("__key", "sketch").hint("merge"), "__key")
        rows = stored(rows.select("bucket", cut.alias("block"), "blocks", "__key", "sketch"), "blocks")
        out = stored(_compared(rows, lambda held: _blocks(held, link), CANDIDATE), "candidates")
        kept.append(rows.withColumn("of_hubs", F.lit(bool(kept))))
        found.append(out.where("a IS NOT NULL").select("a", "b", "first"))
        hubs = out.where("hub IS NOT NULL").select(F.col("hub").alias("__key"), "bucket").distinct()
        if hubs.isEmpty():
            break
        rows = hubs.join(hubs.groupBy("bucket").agg(F.count("*").alias("n")), "bucket")
        block = max(block, 2 * HUBS)
    return union_all(*found).groupBy("a", "b").agg(F.max("first").alias("first")), union_all(*kept)


def left_over(blocks: DataFrame, roots: DataFrame, texts: DataFrame, block: int = BLOCK, link: int = LINK) -> DataFrame:
    """Links that still join two components of a bucket. Buckets of two have had their only pair confirmed.

    Rows outside the bucket's largest component are far. A bucket of at most ``block`` rows is one task; in a larger one
    far and other rows are dealt into groups of half as many, and every two groups with a far one among them are a task.
    So every pair of a bucket that may join two components meets in one task.
    """
    bucket = blocks.join(roots.hint("merge"), blocks["__key"] == roots.node, "left")
    rows = bucket.select("bucket", "block", "blocks", "__key", "sketch", F.coalesce("root", "__key").alias("root"))
    sizes = rows.groupBy("bucket", "root").agg(F.count("*").alias("n"), F.max("blocks").alias("blocks"))
    size, most = F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("most")
    sizes = sizes.groupBy("bucket").agg(size, most, F.count("*").alias("roots"), F.max("blocks").alias("blocks"))
    # one row per block, so that no row of a join meets a whole bucket
    sizes = sizes.where("roots > 1 AND n > 2").select(
        "bucket",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"),
        F.col("most.root").alias("largest"),
        F.when(F.col("n") <= block, F.lit(0)).otherwise(F.ceil((F.col("n") - F.col("most.n")) * 2 / block)).alias("fars"),
        F.ceil(F.col("most.n") * 2 / block).alias("others"),
    )
    rows = rows.drop("blocks").join(sizes.hint("merge"), ["bucket", "block"])
    far = F.col("root") != F.col("largest")
    part = F.pmod(F.xxhash64("__key", "bucket"), F.when(far, F.greatest("fars", F.lit(1))).otherwise(F.col("others")))
    name = lambda i, j: i * (F.col("fars") + F.col("others")) + j
    group = F.col("part")
    # tasks of a far group: itself and each later one, each earlier one, and each group of others; of another: each far group
    with_far = F.transform(F.sequence(F.lit(0).cast("long"), F.col("fars") - 1), lambda k: name(F.least(k, group), F.greatest(k, group)))
    with_others = F.transform(F.sequence(F.lit(0).cast("long"), F.col("others") - 1), lambda k: name(group, F.col("fars") + k))
    from_others = F.transform(F.sequence(F.lit(0).cast("long"), F.col("fars") - 1), lambda k: name(k, F.col("fars") + group))
    tasks = F.when(F.col("fars") == 0, F.array(F.lit(0).cast("long"))).when(F.col("far"), F.concat(with_far, with_others)).otherwise(from_others)
    dealt = rows.withColumn("far", far).withColumn("part", part)
    dealt = dealt.select("bucket", F.explode(tasks).alias("block"), "__key", "sketch", "root", "far", "part")
    return _compared(dealt.join(texts.hint("merge"), "__key"), lambda held: _across(held, link), "u long, v long")


def _confirm(batches: Iterator[pd.DataFrame], link: int) -> Iterator[pd.DataFrame]:
    """Rows sorted by (a, part, b): first the text of a (b missing), then its partners' texts."""
    left, own = None, None
    for batch in batches:
        out = []
        for a, b, text in zip(batch["a"], batch["b"], batch["__text"]):
            if pd.isna(b):
                left, own = a, shingles(text)
                continue
            assert left == a, "the text of a pair's left side is missing"
            other = shingles(text)
            both = len(np.intersect1d(own, other, assume_unique=True))
            if 100 * both >= link * (len(own) + len(other) - both):
                out.append((a, b))
        yield pd.DataFrame(out, columns=["u", "v"], dtype="int64")


def confirmed(pairs: DataFrame, texts: DataFrame, link: int = LINK, part: int = 1000) -> DataFrame:
    """The pairs (a, b) that are links on their full sets.

    Each text travels once per pair it is the right side of; a left side with many partners is repeated
    for every ``part`` of them, so no task gathers a hub's pairs.
    """
    count = pairs.groupBy("a").agg(F.ceil(F.count("*") / part).alias("parts"))
    dealt = pairs.join(count, "a").select("a", "b", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"))
    right = dealt.join(texts.hint("merge"), dealt.b == texts["__key"]).select("a", "part", "b", "__text")
    lefts = count.select("a", F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int"))).alias("part"))
    left = lefts.join(texts.hint("merge"), lefts.a == texts["__key"]).select("a", "part", F.lit(None).cast("long").alias("b"), "__text")
    rows = union_all(left, right).repartition("a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b"))
    return rows.mapInPandas(released(lambda batches: _confirm(batches, link)), "u long, v long")


def clustered(docs: DataFrame, block: int = BLOCK, link: int = LINK) -> DataFrame:
    """``(__key, n_shingles, root)`` for every row of ``docs`` (__key, __text): the least key reachable over links.

    Rows with equal sets are one class, met by an aggregate; only its least row goes on. Rows without words have
    no link. Confirmation first takes the forest of each bucket, then the other candidates that still join
    two components, then every pair of a bucket, also across its blocks, that may join two of what is left.
    """
    signed = stored(signatures(docs, link), "signatures")
    same = ["n_shingles", "fp1", "fp2"]
    slices = partitions(docs.sparkSession)
    some = signed.where("n_shingles > 0").withColumn("slice", F.pmod(F.xxhash64("__key"), F.lit(slices)))
    # a set that a third of all rows share is met in slices; only its least row per slice meets the others
    parts = some.groupBy(*same, "slice").agg(F.min("__key").alias("least"), F.count("*").alias("copies"))
    classes = parts.groupBy(*same).agg(F.min("least").alias("least"), F.sum("copies").alias("copies"), F.collect_list("slice").alias("slices"))
    classes = classes.where("copies > 1").select(*same, F.explode("slices").alias("slice"), "least")
    copies = some.join(classes.hint("merge"), [*same, "slice"]).where("__key > least")
    copies = stored(copies.select(F.col("__key").alias("u"), F.col("least").alias("v")), "copies")
    alone = some.join(copies.select(F.col("u").alias("__key")).hint("merge"), "__key", "left_anti").select("__key", "bands", "sketch")
    alone = stored(alone, "classes")
    pairs, blocks = candidates(alone, block, link)
    pairs = stored(pairs, "pairs")
    # merge joins throughout: whether a side is small enough to broadcast must not depend on the size of the corpus
    # a row of a cut bucket may have its only partner in another block
    involved = union_all(pairs.select(F.explode(F.array("a", "b")).alias("__key")), blocks.where("blocks > 1").select("__key")).distinct()
    texts = stored(docs.select("__key", "__text").join(involved.hint("merge"), "__key", "left_semi"), "texts")
    links = stored(confirmed(pairs.where("first").select("a", "b"), texts, link), "links")
    roots = components(links)
    a, b = (roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
    rest = pairs.where("NOT first").join(a, "a", "left").join(b, "b", "left")
    rest = rest.where("coalesce(ra, a) <> coalesce(rb, b)").select("a", "b")
    links = union_all(links, stored(confirmed(rest, texts, link), "links"))
    links = union_all(links, stored(left_over(blocks.where("NOT of_hubs"), components(links), texts, block, link), "links"))
    discard(alone, pairs, blocks, texts)  # only the links are read from here on
    roots = components(union_all(links, copies))
    out = signed.select("__key", "n_shingles").join(roots.hint("merge"), signed["__key"] == roots.node, "left")
    return out.select("__key", "n_shingles", F.coalesce("root", "__key").alias("root"))


def near_duplicates(docs: DataFrame, column: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with ``__key``, ``n_shingles`` and ``root``, the key of the least document of its group.

    NULL or empty texts have an empty set and stay alone. Equal rows are copies: the first by (key, text) leads.
    """
    keyed = with_key(docs, by=key)
    groups = clustered(keyed.select("__key", utf8(column).alias("__text")))
    return keyed.join(groups, "__key")


def drop_near_duplicates(docs: DataFrame, link: int = LINK) -> DataFrame:
    """One row of each group of near duplicates (``link`` hundredths alike), the least by (doc_id, text), with its own columns."""
    keyed = with_key(docs)
    groups = clustered(keyed.select("__key", utf8().alias("__text")), link=link)
    kept = groups.where("__key = root").select("__key")
    return keyed.join(kept.hint("merge"), "__key", "left_semi").select(docs.columns)


def op9_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    keyed = with_key(docs)
    groups = clustered(keyed.select("__key", utf8().alias("__text")))
    ids = keyed.select("__key", "doc_id")
    out = groups.join(ids.hint("merge"), "__key")
    roots = ids.select(F.col("__key").alias("root"), F.col("doc_id").alias("component_id"))
    out = out.join(roots.hint("merge"), "root")
    return out.select("doc_id", "n_shingles", "component_id", (F.col("__key") == F.col("root")).alias("kept"))
