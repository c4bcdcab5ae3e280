"""Token counts under a unigram vocabulary: Aho-Corasick matches, Viterbi over scores and piece counts."""

from __future__ import annotations

import math

import ahocorasick
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import SentencePieceProcessor

from .common import Memo, small_batches, table

MARK = "▁"
#: An unknown character scores this much below the least score of the vocabulary.
UNKNOWN = 10.0


def read_vocabulary(model_file: str) -> tuple[list[tuple[str, float]], int]:
    """(piece, score) by id and the id of the unknown piece, from a public model file."""
    model = SentencePieceProcessor(model_file=model_file)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())], model.unk_id()


class Counter:
    """Counts the pieces of the best segmentation, as the public unigram tokenizer with byte fallback makes it.

    All matches that end at a character are taken from the longest to the shortest; a later one wins only with a
    strictly better score, which is that tokenizer's rule for ties. A character that no piece of one character
    covers may also be unknown; it then counts as its bytes.
    """

    def __init__(self, vocabulary: list[tuple[str, float]]):
        self.scores = {piece: score for piece, score in vocabulary if piece}
        self.least = min((s for _, s in vocabulary), default=0.0) - UNKNOWN
        self.matches = ahocorasick.Automaton()
        for piece, score in self.scores.items():
            self.matches.add_word(piece, (len(piece), score))
        if self.scores:
            self.matches.make_automaton()

    def __call__(self, word: str) -> int:
        n = len(word)
        best, count = [-math.inf] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        if self.scores:
            for end, found in self.matches.iter(word):
                ends[end].append(found)
        for end in range(n):
            found = sorted(ends[end], reverse=True)
            if word[end] not in self.scores:
                found.append((1, None))
            for length, score in found:
                start = end + 1 - length
                total = best[start] + (self.least if score is None else score)
                if total > best[end + 1]:
                    best[end + 1] = total
                    count[end + 1] = count[start] + (len(word[end].encode("utf-8", "replace")) if score is None else 1)
        return count[n]


def words(text: str) -> list[str]:
    """The text's words with a leading mark each: split at every blank, the first word marked too."""
    if not text:
        return []
    first, *rest = text.split(" ")
    return [MARK + w for w in ([first] if first else []) + rest]


_MEMOS: dict[str, Memo] = {}


def _remembered(model_file: str) -> Memo:
    """One memory of words per worker process, kept from task to task."""
    if model_file not in _MEMOS:
        _MEMOS[model_file] = Memo(Counter(read_vocabulary(model_file)[0]), 1_000_000)
    return _MEMOS[model_file]


COUNTS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())])


def counted(docs: DataFrame, model_file: str, column: str = "text") -> DataFrame:
    """``docs`` with ``n_words`` and ``n_tokens``. NULL and empty texts have none.

    Words are independent under this tokenizer, so a worker segments each distinct word once while it remembers it.
    """
    small_batches(docs.sparkSession)
    @F.pandas_udf(COUNTS)
    def count(texts: pd.Series) -> pd.DataFrame:
        get = _remembered(model_file).__getitem__
        rows = []
        for text in texts:
            own = words(text)
            rows.append((len(own), sum(map(get, own))))
        return pd.DataFrame(rows, columns=["n_words", "n_tokens"], dtype="int64")

    out = docs.withColumn("__c", count(F.coalesce(column, F.lit(""))))
    kept = [c for c in docs.columns if c not in ("n_words", "n_tokens")]
    return out.select(*kept, "__c.n_words", "__c.n_tokens")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return counted(docs, public_tokenizers.path("piece_bpe_32k.model")).drop("text")
