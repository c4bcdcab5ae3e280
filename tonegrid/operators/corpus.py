"""Corpus operators: tokenise, filter, flatten, project."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import stats, text
from ..session import NEG, POS, bounded_batches, released, union_all
from .skew import small_side

# A stopword list up to this size travels inside the plan; a longer one is joined.
INLINE_WORDS = 20_000


def tokenize(df: DataFrame, column: str = "text", pattern: str = text.LETTERS, min_length: int = 2) -> DataFrame:
    """Replace the text column by ``tokens``."""
    kept = [c for c in df.columns if c != column]
    return df.select(*kept, text.words(F.col(column), pattern, min_length).alias("tokens"))


def labelled(docs: DataFrame, labels: DataFrame, flag: str = "quality", key: str = "doc_id") -> DataFrame:
    """Attach ``label`` (pos for 1, neg for 0) from a label table; rows without a label are dropped."""
    named = labels.where(F.col(flag).isNotNull()).select(key, F.when(F.col(flag) == 1, POS).otherwise(NEG).alias("label"))
    return docs.join(named, key)


def flatten(docs: DataFrame) -> DataFrame:
    """One row per token, ``(…, pos, token)`` with ``pos`` from 0."""
    kept = [c for c in docs.columns if c != "tokens"]
    return docs.select(*kept, F.posexplode_outer("tokens").alias("pos", "token")).where(F.col("token").isNotNull())


def stopword_list(stopwords: DataFrame) -> list[str] | None:
    """The words if they fit the inline bound, else None."""
    rows = stopwords.select("token").where("token <> ''").distinct().limit(INLINE_WORDS + 1).collect()
    return None if len(rows) > INLINE_WORDS else sorted(r.token for r in rows)


def remove_stopwords(docs: DataFrame, stopwords: DataFrame) -> DataFrame:
    """Drop listed words from the token arrays; order and repeats are kept.

    A list beyond the inline bound goes through the anti join, with the same result: rows are told apart by all
    their columns (equal rows have equal results, so repeats share one), and NULL tokens stay NULL.
    """
    listed = stopword_list(stopwords)
    if listed is not None:
        return docs.withColumn("tokens", text.drop_words(F.col("tokens"), listed))
    keyed = docs.withColumn("__row", F.sha2(F.to_json(F.struct(*docs.columns)), 256))
    kept = remove_stopword_rows(flatten(keyed.select("__row", "tokens").dropDuplicates(["__row"])), stopwords)
    arrays = kept.groupBy("__row").agg(F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("s"))
    joined = keyed.join(arrays.select("__row", F.col("s.token").alias("__t")), "__row", "left")
    rest = F.when(F.col("tokens").isNotNull(), F.coalesce("__t", F.array().cast("array<string>")))
    return joined.withColumn("tokens", rest).select(docs.columns)


def remove_stopword_rows(tokens: DataFrame, stopwords: DataFrame) -> DataFrame:
    """Anti join form over flattened tokens. A list of counted small size is broadcast: estimates ignore what explode adds."""
    listed = small_side(stopwords.select("token").where("token <> ''").distinct())
    return tokens.join(listed, "token", "left_anti").select(tokens.columns)


def remove_flags(tokens: DataFrame, lexicon: DataFrame | None = None, flags=text.DROP_FLAGS) -> DataFrame:
    """Drop flattened tokens by class, taken from the lexicon where listed, else derived."""
    flag = text.token_flag(F.col("token"))
    if lexicon is None:
        return tokens.where(~flag.isin(*flags))
    known = lexicon.where(F.col("flag").isNotNull()).groupBy("token").agg(F.max("flag").alias("__flag"))
    tagged = tokens.join(known, "token", "left")
    return tagged.where(~F.coalesce("__flag", flag).isin(*flags)).select(tokens.columns)


def clean(
    docs: DataFrame,
    stopwords: DataFrame | None = None,
    column: str = "text",
    pattern: str = text.LETTERS_DIGITS,
    min_length: int = 2,
    flags=text.DROP_FLAGS,
) -> DataFrame:
    """Raw text to filtered tokens: split, length, token class, stopwords."""
    out = tokenize(docs, column, pattern, min_length)
    if flags:
        out = out.withColumn("tokens", text.drop_flags(F.col("tokens"), flags))
    return out if stopwords is None else remove_stopwords(out, stopwords)


def bag_of_words(docs: DataFrame) -> DataFrame:
    """Distinct (document, token) rows; no shuffle, since a document is one row."""
    kept = [c for c in docs.columns if c != "tokens"]
    return docs.select(*kept, F.explode(text.bag(F.col("tokens"))).alias("token"))


def project(docs: DataFrame, features: DataFrame, match_bigrams: bool = False) -> DataFrame:
    """Presence of selected features per document, as ``(…, feature ARRAY<STRING>)``.

    Single tokens only by default, so a selected pair takes a slot but never matches.
    """
    kept = [c for c in docs.columns if c != "tokens"]
    words = features.where(F.size("feature") == 1).select(F.col("feature")[0].alias("token"))
    single = bag_of_words(docs).join(small_side(words), "token", "left_semi").select(*kept, F.array("token").alias("feature"))
    if not match_bigrams:
        return single
    pairs = docs.select(*kept, F.explode(F.array_distinct(text.bigrams(F.col("tokens")))).alias("feature"))
    chosen = small_side(features.where(F.size("feature") == 2).select("feature"))
    pairs = pairs.join(chosen, "feature", "left_semi")
    return stack(single, pairs.select(*kept, "feature"))


PAIRS = T.StructType(
    [T.StructField(c, T.ArrayType(T.StringType())) for c in ("w1", "w2")]
    + [T.StructField(c, T.ArrayType(T.LongType())) for c in ("n", "n1", "n2")]
)


def _pairs(own) -> tuple[list, ...]:
    own = [] if own is None else list(own)
    words, pairs = Counter(own), Counter(zip(own, own[1:]))
    first, second = ([p[i] for p in pairs] for i in (0, 1))
    return first, second, list(pairs.values()), [words[w] for w in first], [words[w] for w in second]


@F.pandas_udf(PAIRS)
def _pair_counts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Adjacent pairs of each token array, how often they occur, and how often their words do."""
    for tokens in batches:
        yield pd.DataFrame([_pairs(own) for own in tokens], columns=PAIRS.names)
    released()


def document_bigrams(docs: DataFrame, n: int = 1000, score: Callable[..., Column] = stats.chi_square) -> DataFrame:
    """The ``n`` best adjacent pairs of each document by association inside that document, ties by pair.

    ``score(n_ii, n_ix, n_xi, n_xx)`` is any Column function. A document is one row, so counting, scoring and ranking happen
    inside it: nothing is exchanged, and rows with the same ``doc_id`` stay apart. NULL or one-word documents have no pair.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.size("tokens").alias("size"), _pair_counts("tokens").alias("p"))
    pairs = F.arrays_zip(*[F.col(f"p.{c}").alias(c) for c in PAIRS.names])

    def scored(p: Column) -> Column:
        value = F.round(score(p["n"], p["n1"], p["n2"], F.col("size")), 6).cast("double")
        return F.struct(p["w1"].alias("w1"), p["w2"].alias("w2"), p["n"].alias("n"), value.alias("score"))

    # highest score first, pairs without one last
    order = lambda p: F.struct(p["score"].isNull().alias("none"), (-p["score"]).alias("down"), p["w1"].alias("w1"), p["w2"].alias("w2"), p.alias("p"))
    best = F.slice(F.sort_array(F.transform(F.transform(pairs, scored), order)), 1, n)
    ranked = rows.select("doc_id", F.posexplode(best).alias("at", "b"))
    return ranked.select("doc_id", F.array("b.w1", "b.w2").alias("feature"), "b.p.n", "b.p.score", (F.col("at") + 1).alias("rank"))


def words_and_bigrams(docs: DataFrame, n: int = 1000, score: Callable[..., Column] = stats.chi_square) -> DataFrame:
    """A document's distinct words plus its best pairs, as ``(doc_id, feature)``."""
    single = bag_of_words(docs.select("doc_id", "tokens")).select("doc_id", F.array("token").alias("feature"))
    return stack(single, document_bigrams(docs, n, score).select("doc_id", "feature"))


def attach_label(df: DataFrame, label: str, extract: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Mark every row of one class's corpus, after an optional feature extractor."""
    out = df.transform(extract) if extract else df
    return out.withColumn("label", F.lit(label))


def stack(*parts: DataFrame) -> DataFrame:
    """Rows of all parts, columns matched by name."""
    return union_all(*parts)


def stack_positional(*parts: DataFrame) -> DataFrame:
    """Rows of all parts, columns matched by position."""
    return union_all(parts[0], *[part.toDF(*parts[0].columns) for part in parts[1:]])
