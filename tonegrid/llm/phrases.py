"""Collocations by set-oriented mining: relations of occurrences, sorted by piece and position, extended word by word.

The relation of length k holds, for every place where a frequent phrase of k words begins, the place and the phrase. It is
merge-joined with itself at the adjacent place, the pairs are counted in groups, and a semi-join with the frequent groups
leaves the relation of length k + 1 (Houtsma and Swami, SETM, 1995). Relations lie in blocks of whole pieces, as sorted
arrays: a piece border is a place without a word, so adjacent places are words of one piece.
"""

from __future__ import annotations

import itertools
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import small_side, top_n
from ..session import union_all
from .common import partitions, small_batches, stored, table, utf8
from .near_dup import mix

#: Places of a block.
BLOCK = 1 << 21
#: Compression of arrays.
LEVEL = 5
#: Bytes of text for one more bucket, in which groups are counted, and for one more task.
BUCKET_BYTES, TASK_BYTES = 8 << 20, 32 << 20
#: Bytes of a text whose words are cut at once; words of a row.
SLICE, ROW = 1 << 20, 1 << 14

MARK = b"\xff"  # no UTF-8 text has it
_LOWER = {b: b + 32 for b in range(65, 91)}
_SPLIT = dict.fromkeys(b".,;:!?\n\x0b\x0c\r", MARK[0])
_BYTES = bytes((_LOWER | _SPLIT).get(b, b) for b in range(256))


def packed(values: np.ndarray) -> bytes:
    """An array as its bytes of one rank after those of another, compressed."""
    wide = np.ascontiguousarray(values.astype("<i8"))
    size = max(1, -(-int(wide.max()).bit_length() // 8)) if len(wide) else 1
    return bytes([size]) + zlib.compress(np.ascontiguousarray(wide.view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes(), LEVEL)


def unpacked(data: bytes) -> np.ndarray:
    size = data[0]
    planes = np.frombuffer(zlib.decompress(data[1:]), np.uint8).reshape(size, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :size] = planes.T
    return out.reshape(-1).view("<i8")


def numbered(refs: np.ndarray) -> bytes:
    """Numbers given from 1 on in order of appearance, 0 for a border, packed: a number's first place says only that it is new."""
    new = np.r_[refs[:1] > 0, refs[1:] > np.maximum.accumulate(refs)[:-1]]
    return packed(np.where(new, 1, np.where(refs > 0, refs + 1, 0)))


def renumbered(data: bytes) -> np.ndarray:
    codes = unpacked(data)
    return np.where(codes == 1, np.cumsum(codes == 1), np.maximum(codes - 1, 0))


def frames(schema: str, rows: Iterator[tuple], size: int = 64) -> Iterator[pd.DataFrame]:
    """Rows of the schema's columns, some at a time."""
    columns = [field.split()[0] for field in schema.split(", ")]
    while some := list(itertools.islice(rows, size)):
        yield pd.DataFrame(some, columns=columns, dtype=object)


def runs(values: np.ndarray, order: np.ndarray) -> Iterator[np.ndarray]:
    """The parts of ``order`` in which ``values`` are equal."""
    if len(order):
        yield from np.split(order, np.flatnonzero(np.diff(values[order])) + 1)


def slices(text: bytes) -> Iterator[bytes]:
    """A long text in parts that end between words."""
    at = 0
    while at < len(text):
        end = text.find(b" ", at + SLICE)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


RELATION = "block long, mask binary, refs binary, bucket long, lang string, words binary, ref binary, n binary, count long"


def _words(batches: Iterator[pd.DataFrame], size: int, buckets: int) -> Iterator[pd.DataFrame]:
    """The relation of single words in blocks, by numbers inside the block; and by bucket what they mean, with counts."""
    number = TaskContext.get().partitionId() << 32
    names: dict = {}
    held: list[np.ndarray] = []
    count, places = itertools.count(1), 0

    def flush() -> Iterator[tuple]:
        refs = np.concatenate(held)
        yield number, None, numbered(refs), *[None] * 6
        times = np.bincount(refs)
        for lang, own in names.items():
            del own[MARK]
            words = list(own)
            ref = np.fromiter(own.values(), np.int64, len(words))
            bucket = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets
            order = np.argsort(bucket, kind="stable")
            for some in runs(bucket, order):
                n = times[ref[some]]
                joined = b" ".join([words[i] for i in some])
                yield number, None, None, int(bucket[some[0]]), lang, joined, packed(ref[some]), packed(n), int(n.sum())

    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"]):
            if lang not in names:
                names[lang] = defaultdict(count.__next__, {MARK: 0})
            own = names[lang]
            for part in slices(text):
                words = part.translate(_BYTES).replace(MARK, b" \xff ").split()
                held.append(np.fromiter(map(own.__getitem__, words), np.int64, len(words)))
                places += len(words)
            held.append(np.zeros(1, np.int64))
            places += 1
            if places >= size:
                yield from frames(RELATION, flush())
                names, held, count, places, number = {}, [], itertools.count(1), 0, number + 1
    if held:
        yield from frames(RELATION, flush())


SINGLES = "block long, at binary, got binary, lang string, id array<long>, word array<binary>, f array<long>"


def _count_words(batches: Iterator[pd.DataFrame], least: int) -> Iterator[pd.DataFrame]:
    """Rows sorted by (bucket, lang): the frequent words of a bucket, numbered, and which words of each block are they."""
    name, held, next_id = None, [], 0

    def done() -> Iterator[tuple]:
        nonlocal next_id
        total: dict[bytes, int] = defaultdict(int)
        for _, words, _, n in held:
            for word, times in zip(words, n):
                total[word] += times
        often = [word for word, times in total.items() if times >= least]
        ids = {word: (name[0] << 32) + next_id + i for i, word in enumerate(often)}
        next_id += len(often)
        for low in range(0, len(often), ROW):
            some = often[low : low + ROW]
            yield -1, None, None, name[1], [ids[w] for w in some], some, [total[w] for w in some]
        for block, words, ref, _ in held:
            hit = [(at, ids[word]) for word, at in zip(words, ref) if word in ids]
            if hit:
                yield block, *[packed(np.array(side, np.int64)) for side in zip(*hit)], None, None, None, None

    for batch in batches:
        for row in batch.itertuples(index=False):
            if (row.bucket, row.lang) != name:
                if held:
                    yield from frames(SINGLES, done())
                next_id = 0 if name is None or row.bucket != name[0] else next_id
                name, held = (int(row.bucket), row.lang), []
            held.append((row.block, row.words.split(b" "), unpacked(row.ref).tolist(), unpacked(row.n).tolist()))
    if held:
        yield from frames(SINGLES, done())


PAIRS = "block long, mask binary, refs binary, known binary, bucket long, base long, x binary, y binary, n binary"


def adjacent(places: np.ndarray, ids: np.ndarray, buckets: int):
    """Merge-join of a relation with itself at the adjacent place.

    Where pairs begin, the number of each one's pair, and the pairs by number: bucket, x, y, n. Numbers follow the buckets.
    """
    near = np.flatnonzero(places[1:] == places[:-1] + 1)
    known, at = np.unique(ids, return_inverse=True)
    codes, refs, n = np.unique(at[near] * len(known) + at[near + 1], return_inverse=True, return_counts=True)
    x, y = known[codes // max(1, len(known))], known[codes % max(1, len(known))]
    bucket = (mix(mix(x.view(np.uint64)) + y.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    return places[near], number[refs], bucket[order], x[order], y[order], n[order]


def extended(block: int, places: np.ndarray, ids: np.ndarray, buckets: int) -> Iterator[tuple]:
    """A block's relation, and the pairs of its adjacent places by bucket."""
    _, refs, bucket, x, y, n = adjacent(places, ids, buckets)
    if not len(refs):
        return
    # a place without a neighbour in the relation is of no further use
    beside = np.diff(places) == 1
    paired = np.r_[beside, False] | np.r_[False, beside]
    known, at = np.unique(ids[paired], return_inverse=True)
    mask = np.zeros(int(places[-1]) + 1, bool)
    mask[places[paired]] = True
    yield block, zlib.compress(np.packbits(mask).tobytes(), LEVEL), packed(at), packed(known), *[None] * 5
    for some in runs(bucket, np.arange(len(bucket))):
        yield block, None, None, None, int(bucket[some[0]]), int(some[0]), packed(x[some]), packed(y[some]), packed(n[some])


def _semi_join(batches: Iterator[pd.DataFrame], buckets: int) -> Iterator[pd.DataFrame]:
    """Rows sorted by (block, kind): a block's relation, then which of its words or pairs are frequent; extended by a word."""
    block, body, replies = None, None, []

    def done() -> Iterator[pd.DataFrame]:
        if body is None or not replies:
            return
        mask, refs, known = body
        if mask is None:
            refs = renumbered(refs)
            places = np.arange(len(refs))
        else:
            places = np.flatnonzero(np.unpackbits(np.frombuffer(zlib.decompress(mask), np.uint8)))
            places, refs, *_ = adjacent(places, unpacked(known)[unpacked(refs)], buckets)
        at, got = (np.concatenate(parts) for parts in zip(*replies))
        found = np.full(int(refs.max()) + 1, -1, np.int64)
        found[at] = got
        ids = found[refs]
        yield from frames(PAIRS, extended(block, places[ids >= 0], ids[ids >= 0], buckets), 16)

    for batch in batches:
        for row in batch.itertuples(index=False):
            if row.block != block:
                yield from done()
                block, body, replies = row.block, None, []
            if row.kind == 0:
                body = row.mask, row.refs, row.known
            else:
                replies.append((unpacked(row.at), unpacked(row.got)))
    yield from done()


GROUPS = "block long, at binary, got binary, id array<long>, x array<long>, y array<long>, f array<long>"


def _count(batches: Iterator[pd.DataFrame], least: int) -> Iterator[pd.DataFrame]:
    """Rows sorted by (bucket, block): the frequent pairs of a bucket, numbered, and which pairs of each block are they."""
    bucket, held = None, []

    def done() -> Iterator[tuple]:
        sides = [np.concatenate([h[k] for h in held]) for k in (2, 3, 4)]
        (known_x, x), (known_y, y) = (np.unique(side, return_inverse=True) for side in sides[:2])
        codes, at = np.unique(x * len(known_y) + y, return_inverse=True)
        order = np.argsort(at, kind="stable")
        sums = np.add.reduceat(sides[2][order], np.searchsorted(at[order], np.arange(len(codes))))
        often = sums >= least
        if not often.any():
            return
        ids = np.where(often, (bucket << 32) + np.cumsum(often) - 1, -1)
        chosen = codes[often]
        level = (ids[often], known_x[chosen // len(known_y)], known_y[chosen % len(known_y)], sums[often])
        for low in range(0, len(chosen), ROW):
            yield -1, None, None, *[v[low : low + ROW].tolist() for v in level]
        got, low = ids[at], 0
        for block, base, own, *_ in held:
            some = got[low : low + len(own)]
            low += len(own)
            hit = np.flatnonzero(some >= 0)
            if len(hit):
                yield block, packed(hit + base), packed(some[hit]), None, None, None, None

    for batch in batches:
        for row in batch.itertuples(index=False):
            if row.bucket != bucket:
                if held:
                    yield from frames(GROUPS, done())
                bucket, held = int(row.bucket), []
            held.append((row.block, int(row.base), *[unpacked(v) for v in (row.x, row.y, row.n)]))
    if held:
        yield from frames(GROUPS, done())


def frequent(docs: DataFrame, least: int, longest: int, block: int = BLOCK) -> tuple[DataFrame, list[DataFrame]]:
    """Words per language ``(lang, n)``; per length the phrases found ``least`` times or more, from the pair tables (id, x, y, f)."""
    spark = docs.sparkSession
    text = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), utf8().alias("text"))
    size = text.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # numbers that grow with the input; given outright, they are not merged again by the size of what is packed
    buckets, tasks = (max(partitions(spark), size // share) for share in (BUCKET_BYTES, TASK_BYTES))
    small_batches(spark)
    relation = stored(text.mapInPandas(lambda batches: _words(batches, block, buckets), RELATION), "words")
    chunks = relation.where("bucket IS NOT NULL")
    total = stored(chunks.groupBy("lang").agg(F.sum("count").alias("n")), "totals")
    small_batches(spark, rows=64, mb=8)
    chunks = chunks.select("block", "bucket", "lang", "words", "ref", "n").repartition(tasks, "bucket").sortWithinPartitions("bucket", "lang")
    found = stored(chunks.mapInPandas(lambda batches: _count_words(batches, least), SINGLES), "singles")
    replies = found.where("block >= 0")
    phrases = found.where("block < 0").select("lang", F.explode(F.arrays_zip("id", "word", "f")).alias("g")).select("lang", "g.*")
    phrases = phrases.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", F.array("f").alias("heads"), F.array("f").alias("tails"))
    levels, known = [phrases], [F.lit(None).cast("binary").alias("known")]
    for length in range(2, longest + 1):
        bodies = relation.where("refs IS NOT NULL").select("block", "mask", "refs", *known, F.lit(0).alias("kind"))
        known = ["known"]
        both = bodies.unionByName(replies.select("block", "at", "got", F.lit(1).alias("kind")), allowMissingColumns=True)
        dealt = both.repartition(tasks, "block").sortWithinPartitions("block", "kind")
        small_batches(spark, rows=16, mb=8)
        relation = stored(dealt.mapInPandas(lambda batches: _semi_join(batches, buckets), PAIRS), "pairs")
        chunks = relation.where("bucket IS NOT NULL").select("block", "bucket", "base", "x", "y", "n")
        found = chunks.repartition(tasks, "bucket").sortWithinPartitions("bucket", "block")
        found = stored(found.mapInPandas(lambda batches: _count(batches, least), GROUPS), "groups")
        pairs = found.where("block < 0").select(F.explode(F.arrays_zip("id", "x", "y", "f")).alias("g")).select("g.*")
        replies = found.where("block >= 0")
        x, y = (levels[-1].select(*[F.col(c).alias(f"{s}_{c}") for c in levels[-1].columns]).hint("merge") for s in "xy")
        joined = pairs.join(x, F.col("x") == F.col("x_id")).join(y, F.col("y") == F.col("y_id"))
        grown = lambda c: F.concat(c, F.array("f"))
        phrase = F.concat(F.col("x_phrase"), F.lit(b" "), F.col("y_last")).alias("phrase")
        fields = ["id", "x", "y", F.col("x_lang").alias("lang"), phrase, F.col("y_last").alias("last"), "f"]
        levels.append(stored(joined.select(*fields, grown("x_heads").alias("heads"), grown("y_tails").alias("tails")), "level"))
    return total, levels


def lowest_cut(length: int) -> Column:
    """``(score, k, l, r)`` of the cut with the lowest score, the smallest k among equals; exact to 38 digits."""
    wide = lambda c: c.cast("decimal(19,0)")
    cuts = []
    for k in range(1, length):
        left, right = F.col("heads")[k - 1], F.col("tails")[length - k - 1]
        score = F.call_function("div", wide(1000 * F.col("f")) * wide(F.col("n")), wide(left) * wide(right))
        cuts.append(F.struct(score.alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r")))
    return F.array_min(F.array(*cuts))


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, block: int = BLOCK) -> DataFrame:
    """Per language (NULL: und) the ``top`` phrases of 2 to ``longest`` words: ``(lang, rank, phrase, a, l, r, n, score)``.

    ``docs`` has ``text`` and ``lang``; other columns are left out. A phrase found ``least`` times or more is scored by its
    weakest cut. It is dropped where a phrase one word longer, which holds it, is as frequent; if a still longer one is, so is
    one of these. NULL and empty texts have no words, equal rows count each, a text of any length is cut in slices between
    words. Ties go by count, then by the bytes of the phrase. An empty table gives an empty result.
    """
    total, levels = frequent(docs, least, longest, block)
    parts = []
    for length, level in enumerate(levels[1:], 2):
        rows = level
        if length < longest:
            longer = levels[length].select(F.explode(F.array("x", "y")).alias("__id"), F.col("f").alias("__f"))
            longer = longer.groupBy("__id").agg(F.max("__f").alias("__f"))
            rows = level.join(longer.hint("merge"), F.col("id") == F.col("__id"), "left").where("__f IS NULL OR __f < f")
        scored = rows.join(small_side(total), "lang").withColumn("c", lowest_cut(length))
        parts.append(scored.select("lang", F.col("phrase").cast("string").alias("phrase"), F.col("f").alias("a"), "c.l", "c.r", "n", "c.score"))
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    ranked = top_n(union_all(*parts), ["lang"], best, top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def oracle(least: int = 100, longest: int = 5, top: int = 2000) -> str:
    """Counts of all phrases by windows over the words, cuts and containment by strings."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    joined = lambda k: " || ' ' || ".join(f"w{i}" for i in range(k))
    heads = " UNION ALL ".join(
        f"SELECT lang, {k} AS k, {joined(k)} AS phrase FROM grams WHERE w{k - 1} IS NOT NULL" for k in range(1, longest + 1)
    )
    leads = ", ".join(f"lead(t, {i}) OVER (PARTITION BY d, p ORDER BY i) AS w{i}" for i in range(1, longest))
    return f"""WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{upper}', '{lower}') AS text
        FROM documents),
        pieces AS (SELECT d, lang, generate_subscripts(s, 1) AS p, unnest(s) AS piece
        FROM (SELECT d, lang, string_split_regex(text, '[.,;:!?\\x0A-\\x0D]') AS s FROM docs)),
        words AS (SELECT d, lang, p, generate_subscripts(s, 1) AS i, unnest(s) AS t
        FROM (SELECT d, lang, p, regexp_extract_all(piece, '[^ \\t]+') AS s FROM pieces)),
        grams AS (SELECT lang, t AS w0, {leads} FROM words),
        freq AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM ({heads}) GROUP BY ALL HAVING count(*) >= {least}),
        sizes AS (SELECT lang, count(*) AS n FROM words GROUP BY lang),
        cuts AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS s, unnest(range(1, k)) AS cut FROM freq WHERE k > 1),
        scored AS (SELECT c.lang, c.k, c.phrase, a, l.f AS l, r.f AS r, n, ((1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f))::BIGINT AS score, cut
        FROM cuts c JOIN freq l ON l.lang = c.lang AND l.phrase = array_to_string(s[:cut], ' ')
        JOIN freq r ON r.lang = c.lang AND r.phrase = array_to_string(s[cut + 1:], ' ') JOIN sizes ON sizes.lang = c.lang
        QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, cut) = 1)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
        FROM scored WHERE NOT EXISTS (FROM freq g WHERE g.lang = scored.lang AND g.k > scored.k AND g.f >= scored.a
        AND contains(' ' || g.phrase || ' ', ' ' || scored.phrase || ' ')) QUALIFY rank <= {top}"""
