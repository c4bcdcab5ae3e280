"""Exact substring dedup: every 100-byte string keeps its first place, all later ones are removed.

Anchors (the least gram hash of each 100-byte window) bring together the places that can hold equal strings. Equal
segments around an anchor are settled by fingerprint; segments that share an anchor but differ go to shards, each with a
suffix array, common prefixes, and a binary search in the shards before it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import union_all
from .common import offsets, released, small_batches, stored, table, utf8, with_key
from .near_dup import mix

#: Bytes of a repeated string, of a gram, and gram positions in a string.
LENGTH, GRAM = 100, 32
REACH = LENGTH - GRAM + 1
#: Ranges of the anchor's offset in a string; a shard's segments agree on all but 17 bytes of a string.
PARTS = 4
#: Bytes that are hashed at once, and bytes in one suffix array.
CHUNK, SHARD = 1 << 19, 1 << 20
#: Three numbers below this fit a long.
PACKED = 1 << 21
#: Segments that are handed on at once.
HANDED = 20_000

_RANDOM = np.random.default_rng(8)
_BYTES = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = int(_RANDOM.integers(1, 2**62)) * 2 + 1
_INVERSE = pow(_BASE, -1, 2**64)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    if len(_POWERS.get(base, ())) < n:
        factors = np.full(n, base, np.uint64)
        factors[0] = 1
        _POWERS[base] = np.multiply.accumulate(factors)
    return _POWERS[base][:n]


class Hashes:
    """Hashes of any substring of ``data`` from one running sum (a polynomial modulo 2^64, then mixed)."""

    def __init__(self, data: np.ndarray):
        terms = _BYTES[data] * powers(_BASE, len(data))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
        self.undo = powers(_INVERSE, len(data) + 1)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.undo[starts])

    def grams(self, size: int) -> np.ndarray:
        return mix((self.sums[size:] - self.sums[:-size]) * self.undo[: len(self.sums) - size])


def leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost least value in each window of ``width`` (doubling)."""
    least, at = values, np.arange(len(values), dtype=np.int32)
    size = 1
    while size < width:
        step = min(size, width - size)
        left, right = least[:-step], least[step:]
        at = np.where(right < left, at[step:], at[:-step])
        least = np.minimum(left, right)
        size += step
    return at


def anchors(texts: list[bytes]) -> pd.DataFrame:
    """Runs of string starts with the same anchor: doc (index), start, n (starts), at (anchor), m and s (hashes)."""
    pieces = []
    for doc, text in enumerate(texts):
        for at in range(0, max(0, len(text) - LENGTH + 1), CHUNK):
            pieces.append((doc, at, text[at : at + CHUNK + LENGTH - 1]))
    out, held, size = [], [], 0
    for piece in pieces:
        held.append(piece)
        size += len(piece[2])
        if size >= CHUNK:
            out.append(_runs(held))
            held, size = [], 0
    if held:
        out.append(_runs(held))
    if not out:
        return pd.DataFrame({c: np.empty(0, np.int64) for c in ("doc", "start", "n", "at", "m", "s")})
    return pd.concat(out, ignore_index=True)


def _runs(pieces: list[tuple[int, int, bytes]]) -> pd.DataFrame:
    data = np.frombuffer(b"".join(p[2] for p in pieces), np.uint8)
    starts = offsets([len(p[2]) for p in pieces])
    hashes = Hashes(data)
    gram = hashes.grams(GRAM)
    least = leftmost_least(gram, REACH)
    owner = np.repeat(np.arange(len(pieces)), np.diff(starts))[: len(least)]
    inside = np.arange(len(least)) + LENGTH <= starts[owner + 1]
    change = np.r_[True, (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])] & inside
    first = np.flatnonzero(change)
    count = np.add.reduceat(inside.astype(np.int64), first)
    piece, anchor = owner[first], least[first]
    shift = np.array([p[1] for p in pieces])[piece] - starts[piece]
    return pd.DataFrame(
        {
            "doc": np.array([p[0] for p in pieces])[piece],
            "start": first + shift,
            "n": count,
            "at": anchor + shift,
            "m": gram[anchor].view(np.int64),
            "s": hashes(first, first + count + LENGTH - 1).view(np.int64),
        }
    )


def intervals(key: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pd.DataFrame:
    """Byte spans of strings that start in [start, stop), touching ones of a key joined."""
    order = np.lexsort((start, key))
    key, start, stop = key[order], start[order], stop[order] + LENGTH - 1
    if not len(key):
        return pd.DataFrame({"__key": key, "from": start, "to": stop})
    group = np.cumsum(np.r_[0, key[1:] != key[:-1]])
    span = int(stop.max()) + 1
    reach = np.maximum.accumulate(stop + group * span) - group * span
    fresh = np.r_[True, (key[1:] != key[:-1]) | (start[1:] > reach[:-1])]
    at = np.flatnonzero(fresh)
    return pd.DataFrame({"__key": key[at], "from": start[at], "to": np.maximum.reduceat(stop, at)})


#: A run of starts with its anchor; with ``n`` 0, a span to remove from ``start`` to ``at``.
MARKED = "m long, s long, __key long, start long, n long, at long"
_COLUMNS = ["m", "s", "__key", "start", "n", "at"]


def _marked(spans: pd.DataFrame) -> pd.DataFrame:
    """Spans as rows among the runs; they have no anchor and are dealt by their document."""
    out = spans.rename(columns={"from": "start", "to": "at"})
    return out.assign(m=spans["__key"], s=0, n=0)[_COLUMNS]


def _settle(rows: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Of rows sorted by (m, s, __key, start): the first of each (m, s), and the spans of all others."""
    again = ((rows["m"] == rows["m"].shift()) & (rows["s"] == rows["s"].shift())).to_numpy()
    rest = rows[again]
    start = rest["start"].to_numpy()
    return rows[~again], intervals(rest["__key"].to_numpy(), start, start + rest["n"].to_numpy())


def _local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Anchor runs of each batch; segments that repeat inside it are settled here and travel no further."""
    for batch in batches:
        found = anchors(list(batch["__text"]))
        found["__key"] = batch["__key"].to_numpy()[found["doc"]]
        kept, spans = _settle(found.sort_values(["m", "s", "__key", "start"], kind="stable"))
        yield kept[_COLUMNS]
        if len(spans):
            yield _marked(spans)


def _shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs sorted by (m, s, __key, start): spans of repeated segments, and one run per segment of a shared anchor.

    Spans that are known already pass through.
    """
    held = None
    for batch in batches:
        known = (batch["n"] == 0).to_numpy()
        if known.any():
            yield batch[known]
            batch = batch[~known]
            if not len(batch):
                continue
        held = batch if held is None else pd.concat([held, batch], ignore_index=True)
        open_ = (held["m"] == held["m"].iloc[-1]).to_numpy()
        if not open_.all():
            yield from _shared_groups(held[~open_])
            held = held[open_]
        elif len(held) > 200_000:  # a hot anchor: settle what is here, keep one run per segment
            held, spans = _settle(held)
            yield _marked(spans)
    if held is not None and len(held):
        yield from _shared_groups(held)


def _shared_groups(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    kept, spans = _settle(rows)
    if len(spans):
        yield _marked(spans)
    m = kept["m"].to_numpy()
    same = np.r_[False, m[1:] == m[:-1]]
    kept = kept[same | np.r_[same[1:], False]]
    if len(kept):
        yield kept


SEGMENT = "shard long, __key long, start long, segment binary"


def _segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per run and range of the anchor's offset: the bytes under its strings, keyed by what all of them share."""
    step = -(-REACH // PARTS)
    columns = ["shard", "__key", "start", "segment"]
    out: list[tuple] = []
    for batch in batches:
        for key, text, runs in zip(batch["__key"], batch["__text"], batch["runs"]):
            text = bytes(text)
            for run in runs:
                if len(out) >= HANDED:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
                start, n, at = int(run["start"]), int(run["n"]), int(run["at"])
                for part in range(PARTS):
                    # strings whose anchor lies low .. high bytes behind their start
                    low, high = part * step, min(REACH, (part + 1) * step) - 1
                    first, last = max(start, at - high), min(start + n - 1, at - low)
                    if first <= last:
                        common = text[at - low : at - high + LENGTH]
                        shard = hashlib.blake2b(common + bytes([part]), digest_size=8).digest()
                        out.append((int.from_bytes(shard, "little", signed=True), key, first, text[first : last + LENGTH]))
    if out:
        yield pd.DataFrame(out, columns=columns)


def suffix_array(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Larsson-Sadakane refinement up to LENGTH bytes: the order, and each suffix's place in it.

    A group is numbered by its first place, so in each round only groups of two or more are sorted again, by the
    numbers one step further on.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key <<= np.uint64(8)
        key |= padded[k : k + n]
    order = np.argsort(key).astype(np.int32)  # equal ones take text order in the first round
    key = key[order]
    fresh = np.r_[True, key[1:] != key[:-1]]
    del key, padded
    place = np.arange(n, dtype=np.int32)
    rank = np.empty(n + 1, np.int32)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(fresh, place, 0))
    step = 8
    while step < LENGTH:
        tied = np.flatnonzero(~fresh | ~np.r_[fresh[1:], True])
        if not len(tied):
            break
        sub = order[tied]
        after = rank[np.minimum(sub + step, n)]
        own = rank[sub]
        if n < PACKED:  # (own, after, sub) fit one number, and numbers sort faster than places
            packed = (own.astype(np.int64) * PACKED + (after + 1)) * PACKED + sub
            packed.sort()
            sub, pair = (packed % PACKED).astype(np.int32), packed // PACKED
            new = np.r_[True, pair[1:] != pair[:-1]]
        else:
            again = np.lexsort((sub, after, own))
            sub, after, own = sub[again], after[again], own[again]
            new = np.r_[True, (own[1:] != own[:-1]) | (after[1:] != after[:-1])]
        order[tied] = sub
        rank[sub] = np.maximum.accumulate(np.where(new, tied, 0))
        fresh[tied] = new
        step *= 2
    spot = np.empty(n, np.int32)
    spot[order] = place
    return order, spot


def common_prefixes(data: np.ndarray, starts: np.ndarray, order: np.ndarray, spot: np.ndarray) -> np.ndarray:
    """Kasai: common prefix of each suffix with the one before it in order, up to LENGTH and inside its segment.

    The segments are walked side by side: going one byte on in each loses at most one byte of its last prefix.
    """
    ends = np.repeat((starts[1:] - 1).astype(np.int32), np.diff(starts))
    out = np.zeros(len(data), np.int16)
    lanes = np.arange(len(starts) - 1)
    at, have = starts[:-1].copy(), np.zeros(len(lanes), np.int64)
    while True:
        lanes = lanes[at[lanes] < starts[lanes + 1]]
        if not len(lanes):
            return out
        p = at[lanes]
        place = spot[p]
        q = np.where(place > 0, order[place - 1], 0)
        room = np.where(place > 0, np.minimum(LENGTH, np.minimum(ends[p] - p, ends[q] - q)), 0)
        h = np.minimum(have[lanes], room)
        live = np.flatnonzero(h < room)
        while len(live):
            live = live[data[p[live] + h[live]] == data[q[live] + h[live]]]
            h[live] += 1
            live = live[h[live] < room[live]]
        out[place] = h
        have[lanes] = np.maximum(h - 1, 0)
        at[lanes] += 1


def repeats(
    keys: np.ndarray, begins: np.ndarray, segments: list[bytes], known: np.ndarray, more: bool
) -> tuple[pd.DataFrame, np.ndarray]:
    """Spans of the strings of one shard that start earlier in it or are ``known``; with ``more``, the strings it adds.

    Segments come sorted by (key, start); ``known`` are the sorted strings of the shards before, all earlier.
    """
    # a byte that no UTF-8 text has ends each segment, so what runs over an end equals no string
    starts = offsets([len(s) + 1 for s in segments])
    data = np.frombuffer(b"\xff".join([*segments, b""]), np.uint8)
    order, spot = suffix_array(data)
    shared = common_prefixes(data, starts, order, spot)
    owner = np.repeat(np.arange(len(segments), dtype=np.int32), np.diff(starts))
    whole = (np.arange(len(data)) + LENGTH < starts[owner + 1])[order]
    places, shared = order[whole], shared[whole]
    group = np.cumsum(shared < LENGTH)  # equal strings are neighbours in order
    by = np.lexsort((begins[owner[places]] + places - starts[owner[places]], keys[owner[places]], group))
    places, group = places[by], group[by]
    again = np.r_[False, group[1:] == group[:-1]]
    strings = known[:0]
    if more or len(known):  # only a group that takes several arrays needs its strings themselves
        windows = np.lib.stride_tricks.sliding_window_view(data, LENGTH)
        strings = np.ascontiguousarray(windows[places[~again]]).view(f"S{LENGTH}")[:, 0]
    if len(known):
        at = np.minimum(np.searchsorted(known, strings), len(known) - 1)
        old = known[at] == strings
        again[~again] = old
        strings = strings[~old]
    hit = places[again]
    begin = begins[owner[hit]] + hit - starts[owner[hit]]
    return intervals(keys[owner[hit]], begin, begin + 1), strings


def _resolve(batches: Iterator[pd.DataFrame], limit: int) -> Iterator[pd.DataFrame]:
    """Segments sorted by (shard, __key, start): whole groups fill a suffix array; a larger group takes several."""
    known, last = np.empty(0, f"S{LENGTH}"), None
    parts: list[pd.DataFrame] = []
    size = 0

    def flush(rows: pd.DataFrame) -> pd.DataFrame:
        nonlocal known, last
        if rows["shard"].iloc[0] != last:
            known = known[:0]
        single = rows["shard"].iloc[0] == rows["shard"].iloc[-1]
        spans, added = repeats(rows["__key"].to_numpy(), rows["start"].to_numpy(), list(rows["segment"]), known, single)
        known = np.sort(np.concatenate([known, added])) if single else known[:0]
        last = rows["shard"].iloc[-1] if single else None
        return spans

    for batch in batches:
        parts.append(batch)
        size += int(batch["segment"].map(len).sum())
        if size < limit:
            continue
        held = pd.concat(parts, ignore_index=True)
        open_ = (held["shard"] == held["shard"].iloc[-1]).to_numpy()
        if not open_.all():
            yield flush(held[~open_])
            parts = [held[open_]]
            size = int(parts[0]["segment"].map(len).sum())
        elif size >= 2 * limit:
            yield flush(held)
            parts, size = [], 0
        else:
            parts = [held]
    if parts:
        held = pd.concat(parts, ignore_index=True)
        open_ = (held["shard"] == held["shard"].iloc[0]).to_numpy()
        if not open_.all() and held["shard"].iloc[0] == last:
            yield flush(held[open_])
            held = held[~open_]
        yield flush(held)


def spans_to_remove(keyed: DataFrame, shard_bytes: int = SHARD) -> DataFrame:
    """``(__key, __spans)``: for every row of ``keyed`` (__key, __text) with repeated strings, unordered byte spans.

    A segment that repeats inside a batch is settled there, so a passage that many documents hold sends one run
    per batch into the shuffle, not one per document.
    """
    small_batches(keyed.sparkSession, rows=1 << 15, mb=2)  # texts and runs (six numbers) in one job: the bytes bound both
    runs = keyed.mapInPandas(released(_local), MARKED)  # many times the rows of the texts, so they are not stored
    dealt = runs.repartition("m").sortWithinPartitions("m", "s", "__key", "start")
    settled = stored(dealt.mapInPandas(released(_shared), MARKED), "settled")
    wanted = settled.where("n > 0").groupBy("__key").agg(F.collect_list(F.struct("start", "n", "at")).alias("runs"))
    texts = keyed.join(wanted.hint("merge"), "__key")
    small_batches(keyed.sparkSession, rows=512, mb=2)  # a run is some hundred bytes in Python
    segments = texts.select("__key", "__text", "runs").mapInPandas(released(_segments), SEGMENT)

    def resolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _resolve(batches, shard_bytes)

    dealt = segments.repartition("shard").sortWithinPartitions("shard", "__key", "start")
    found = stored(dealt.mapInPandas(released(resolve), "__key long, `from` long, `to` long"), "resolved")
    known = settled.where("n = 0").select("__key", F.col("start").alias("from"), F.col("at").alias("to"))
    return union_all(known, found).groupBy("__key").agg(F.collect_list(F.struct("from", "to")).alias("__spans"))


CUT = T.StructType(
    [
        T.StructField("n_removed", T.LongType()),
        T.StructField("n_spans", T.LongType()),
        T.StructField("kept", T.BinaryType()),
    ]
)


def _kept(text: bytes, spans) -> tuple[int, int, bytes]:
    kept, end, count = [], 0, 0
    for a, b in sorted((s["from"], s["to"]) for s in spans) if spans is not None else []:
        if a > end or not count:
            kept.append(text[end:a])
            count += 1
        end = max(end, b)
    kept.append(text[end:])
    rest = b"".join(kept)
    return len(text) - len(rest), count, rest


@F.pandas_udf(CUT)
def _cut(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_kept(text, own) for text, own in zip(texts, spans)], columns=["n_removed", "n_spans", "kept"])


@F.pandas_udf(T.StringType())
def _rest(texts: pd.Series, spans: pd.Series) -> pd.Series:
    """The text that is left; NULL if nothing is removed."""
    found = (_kept(text, own) for text, own in zip(texts, spans))
    return pd.Series([rest.decode("utf-8", "ignore") if n else None for n, _, rest in found], dtype=object)


def _with_spans(docs: DataFrame, shard_bytes: int = SHARD) -> DataFrame:
    """``docs`` with ``__key`` and ``__spans``.

    Rows with one id count as documents in text order; of equal rows the first keeps its text.
    """
    keyed = with_key(docs)
    spans = spans_to_remove(keyed.select("__key", utf8().alias("__text")), shard_bytes)
    small_batches(docs.sparkSession, rows=1024, mb=4)
    return keyed.join(spans.hint("merge"), "__key", "left")


def deduplicated(docs: DataFrame, shard_bytes: int = SHARD) -> DataFrame:
    """``docs`` with ``__bytes`` and ``__cut`` (n_removed, n_spans, kept bytes), judged on the input.

    NULL or short texts lose nothing. Rows with one id count as documents in text order; of equal rows the first
    keeps its text.
    """
    joined = _with_spans(docs, shard_bytes)
    return joined.withColumn("__cut", _cut(utf8(), "__spans")).withColumn("__bytes", F.length(utf8())).drop("__spans", "__key")


def drop_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` without repeated strings; ``n_chars`` follows the text. Documents with nothing left go.

    Bytes of a character that is cut in two are dropped with it.
    """
    # not deterministic, so that Spark runs one worker a task and does not copy the function into the filter
    out = _with_spans(docs).withColumn("__rest", _rest.asNondeterministic()(utf8(), "__spans"))
    out = out.where("__rest IS NULL OR __rest <> ''").withColumn("text", F.coalesce("__rest", "text"))
    if "n_chars" in docs.columns:
        n_chars = F.when(F.col("__rest").isNotNull(), F.length("text")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", n_chars.cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id",
        F.col("__bytes").cast("long").alias("n_bytes"),
        "__cut.n_removed",
        "__cut.n_spans",
        F.sha2(F.col("__cut.kept"), 256).alias("kept_sha256"),
    )
