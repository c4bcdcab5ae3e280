"""Best-fit packing planned on the histogram of lengths; documents then take the planned slots by rank."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .common import partitions, small_batches, stored, table, utf8

CAPACITY = 4096
END = 1

PIECES = T.StructType(
    [T.StructField("lengths", T.ArrayType(T.LongType())), T.StructField("crcs", T.ArrayType(T.LongType()))]
)


_END = np.array([END], "<u4").tobytes()


#: Latin letters beyond ASCII; the one whose lower case is two characters is not among them.
_LATIN = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"
#: The tokenizer's own split, for text in these letters whose ASCII is in lower case.
_WORDS = re.compile(f"[a-z{_LATIN}]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^a-z0-9{_LATIN}]+")
#: Whatever else may compose, change its class or begin a special string: such a run stays whole.
_ODD = re.compile(f"[^\\x21-\\x7f{_LATIN}]|<\\|")


def _shown() -> dict[int, str]:
    """Byte-level tokenizers write a byte that Latin-1 prints as that character, the others as U+0100 onwards."""
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printed]
    return {b: chr(b) for b in printed} | {b: chr(256 + i) for i, b in enumerate(others)}


_SHOWN = _shown()


def words(run: bytes) -> list[bytes]:
    """Parts of a run without white space that the tokenizer encodes independently of each other."""
    low = run.lower().decode("utf-8")  # ASCII letters only; the tokenizer lower-cases the others
    return [run] if _ODD.search(low) else [w.encode("utf-8") for w in _WORDS.findall(low)]


class Ids:
    """Ids of runs of text and of their words. A generation is bounded in bytes; when it is full, the one before is forgotten.

    What is in use moves on to the new generation, so frequent words are encoded once. Runs of over ``LONG`` bytes are not
    kept.
    """

    LONG, SPARE = 256, 250

    def __init__(self, tokenizer_file: str, limit: int = 56 << 20):
        self.tokenizer, self.limit = Tokenizer.from_file(tokenizer_file), limit
        self.model = self.tokenizer.model
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.size = 0

    def of(self, text: bytes) -> bytes:
        runs = text.split()  # bytes split at ASCII white space only
        if self.size > self.limit:
            self.old, self.young, self.size = self.young, {}, 0
        new = self._missing(set(runs))
        if new:
            cut = {run: words(run) for run in new}
            self._keep(self._encoded(self._missing({w for own in cut.values() for w in own})))
            self._keep({run: b"".join([self.young[w] for w in own]) for run, own in cut.items() if own != [run]})
        out = b"".join(map(self.young.__getitem__, runs))
        if new:
            for run in {run for run in new.union(*cut.values()) if len(run) > self.LONG}:
                self.size -= len(run) + len(self.young.pop(run)) + self.SPARE
        return out

    def _missing(self, keys: set[bytes]) -> set[bytes]:
        new = keys.difference(self.young)
        self._keep({key: self.old[key] for key in new if key in self.old})
        return new.difference(self.young)

    def _keep(self, found: dict[bytes, bytes]) -> None:
        self.young.update(found)
        self.size += sum(len(key) + len(ids) + self.SPARE for key, ids in found.items())

    def _encoded(self, unknown: set[bytes]) -> dict[bytes, bytes]:
        """Ids from the tokenizer's model for a word, from the whole tokenizer for a run that is not cut."""
        out = {}
        for run in unknown:
            text = run.decode("utf-8")
            if _ODD.search(text):
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            else:
                ids = [t.id for t in self.model.tokenize(text.lower().encode("utf-8").decode("latin-1").translate(_SHOWN))]
            out[run] = np.array(ids, "<u4").tobytes()
        return out


_MEMOS: dict[str, Ids] = {}


def _remembered(tokenizer_file: str) -> Ids:
    """One memory per worker process, kept from task to task."""
    if tokenizer_file not in _MEMOS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _MEMOS[tokenizer_file] = Ids(tokenizer_file)
    return _MEMOS[tokenizer_file]


def tokenized(text: Column, tokenizer_file: str, capacity: int = CAPACITY, ids: bool = False) -> Column:
    """Pieces of a UTF-8 text: lengths and CRC-32 of their ids, or with ``ids`` the ids of the whole document.

    The tokenizer works inside runs between ASCII white space, and inside the words of a run (no token, composition or
    special string spans them), so each distinct word is encoded once per worker, as long as it is remembered.
    """

    def joined(values: pd.Series) -> Iterator[bytes]:
        memo = _remembered(tokenizer_file)
        for value in values:
            yield memo.of(value) + _END

    if ids:

        @F.pandas_udf(T.ArrayType(T.LongType()))
        def encode(texts: pd.Series) -> pd.Series:
            return pd.Series([np.frombuffer(whole, "<u4").astype(np.int64) for whole in joined(texts)])

        return encode(text)

    @F.pandas_udf(PIECES)
    def pieces(texts: pd.Series) -> pd.DataFrame:
        lengths, crcs = [], []
        for whole in joined(texts):
            cut = [whole[at : at + 4 * capacity] for at in range(0, len(whole), 4 * capacity)]
            lengths.append([len(c) // 4 for c in cut])
            crcs.append([zlib.crc32(c) for c in cut])
        return pd.DataFrame({"lengths": lengths, "crcs": crcs})

    return pieces(text)


def plan(counts: Mapping[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Best fit, longest first, over counts: rows (length, first rank, pieces, first sequence, offset).

    Sequences filled alike form one class; a row lays one piece into each of a class's sequences. Both the
    classes and the rows depend on the number of different lengths, not on that of pieces.
    """
    free: dict[int, list[tuple[int, int]]] = {}
    rows, sequences = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = min((r for r, classes in free.items() if r >= length and classes), default=None)
            if room is None:
                room, fresh = capacity, -(-left // (capacity // length))
                first, many = sequences, fresh
                sequences += fresh
            else:
                first, many = free[room].pop()
            fits = room // length
            full = min(many, left // fits)
            for layer in range(fits if full else 0):
                rows.append((length, rank, full, first, capacity - room + layer * length))
                rank += full
            left -= full * fits
            if full:
                free.setdefault(room - fits * length, []).append((first, full))
            if full < many:
                some = left  # fewer than one sequence takes
                for layer in range(some):
                    rows.append((length, rank, 1, first + full, capacity - room + layer * length))
                    rank += 1
                left = 0
                if some:
                    free.setdefault(room - some * length, []).append((first + full, 1))
                if full + bool(some) < many:
                    free.setdefault(room, []).append((first + full + bool(some), many - full - bool(some)))
    return np.array(rows, np.int64).reshape(-1, 5)


def packed(pieces: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (a stored table with ``length``) plus ``sequence_id`` and ``offset``.

    Only the histogram, at most ``capacity`` rows, goes through the driver. Ranks within a length are counted in as
    many slices as there are shuffle partitions, so a length that most pieces share is spread like any other.
    """
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows = plan(histogram, capacity)
    starts = (rows[:, 0] << 42) + rows[:, 1]
    by_start = np.argsort(starts)
    starts, rows = starts[by_start], rows[by_start]
    slices = partitions(pieces.sparkSession)
    dealt = pieces.withColumn("__slice", F.pmod(F.xxhash64(*order), F.lit(slices)))
    sizes = dealt.groupBy("length", "__slice").agg(F.count("*").alias("__n"))
    ahead = W.partitionBy("length").orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select("length", "__slice", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__before"))
    inside = F.row_number().over(W.partitionBy("length", "__slice").orderBy(*order)) - 1
    ranked = dealt.withColumn("__in", inside).join(sizes.hint("merge"), ["length", "__slice"])

    @F.pandas_udf("sequence_id long, offset long")
    def slot(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(starts, (length.to_numpy() << 42) + rank.to_numpy(), "right") - 1
        return pd.DataFrame({"sequence_id": rows[at, 3] + rank.to_numpy() - rows[at, 1], "offset": rows[at, 4]})

    placed = ranked.withColumn("__slot", slot("length", (F.col("__in") + F.col("__before")).cast("long")))
    return placed.select(*pieces.columns, "__slot.sequence_id", "__slot.offset")


def pack_documents(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of each document: its place in the document and in the packed sequences.

    A NULL or empty text is a document of the end token alone. Equal rows are packed each for itself. An empty
    table gives no piece.
    """
    small_batches(docs.sparkSession, mb=4)
    cut = docs.select("doc_id", tokenized(utf8(), tokenizer_file, capacity).alias("p"))
    cut = cut.select("doc_id", F.posexplode(F.arrays_zip("p.lengths", "p.crcs")).alias("piece", "c"))
    pieces = cut.select(
        "doc_id",
        "piece",
        (F.col("piece").cast("long") * capacity).alias("start"),
        F.col("c.lengths").alias("length"),
        F.col("c.crcs").alias("ids_crc32"),
    )
    return packed(stored(pieces, "pieces"), ["doc_id", "piece", "ids_crc32"], capacity)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
