"""Column expressions over raw text and token arrays. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LETTERS = r"\p{L}+"
LETTERS_DIGITS = r"[\p{L}\p{N}]+"

# Token classes dropped by default: Latin words, numerals, numeral + measure word.
DROP_FLAGS = ("eng", "m", "mq")


def words(text: Column, pattern: str = LETTERS, min_length: int = 2) -> Column:
    """Lower-cased matches of ``pattern`` in text order, at least ``min_length`` characters long."""
    found = F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))
    return long_enough(found, min_length)


def long_enough(tokens: Column, min_length: int = 2) -> Column:
    return F.filter(tokens, lambda t: F.length(t) >= min_length)


def token_flag(token: Column) -> Column:
    """``m`` for digits only, ``eng`` for other Latin letters and digits, else ``x``."""
    return (
        F.when(token.rlike("^[0-9]+$"), "m")
        .when(token.rlike("^[A-Za-z0-9]+$"), "eng")
        .otherwise("x")
    )


def drop_flags(tokens: Column, flags=DROP_FLAGS) -> Column:
    return F.filter(tokens, lambda t: ~token_flag(t).isin(*flags))


def drop_words(tokens: Column, listed: list[str]) -> Column:
    """Order-keeping removal of a short word list (a hashed set inside the expression)."""
    if not listed:
        return tokens
    return F.filter(tokens, lambda t: ~t.isin(*listed))


def token_rows(docs: DataFrame, *keys: str) -> DataFrame:
    """``(keys…, token)``, one row per token.

    An inner explode of a plain column makes the optimiser infer a size filter and push it below
    the tokeniser, which then runs once more per pushed copy; the outer form does not.
    """
    return docs.select(*keys, F.explode_outer("tokens").alias("token")).where(F.col("token").isNotNull())


def bag(tokens: Column) -> Column:
    """Presence set of a document."""
    return F.array_distinct(tokens)


def bigrams(tokens: Column) -> Column:
    """Adjacent pairs of one token array, as two-element arrays.

    ``tokens`` should be a plain column: it is read once per element.
    """
    tail = F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0)))
    return F.transform(tail, lambda t, i: F.array(tokens[i], t))


def feature_text(feature: Column) -> Column:
    """Printable form of a one- or two-word feature."""
    return F.array_join(feature, " ")
