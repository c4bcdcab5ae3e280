"""Quality rules with thresholds learned per language and source from mergeable quantile sketches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.skew import small_side, within
from .common import small_batches, stored, table, utf8

WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = b"#*$%&|<>"
WINDOW = 5

#: Rates in thousandths (repeats have the base rule): (name, numerator, denominator, least spread, lower side too)
RATES = (
    ("symbol_rate", "n_symbols", "word_chars", 20, False),
    ("dup_line_rate", "n_dup_lines", "n_lines", 150, False),
    ("word_length", "word_chars", "n_words", 1000, True),
)
#: Fences lie this many spreads (interquartile ranges, at least the rate's own) beyond the quartiles.
FENCE = 3
#: Percents below the lower quartile from which an upper limit starts to climb.
CLIMB = (5, 10)
#: A group with fewer documents takes the thresholds of its language, then of all documents.
GROUP_ROWS = 100

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes]) -> int:
    """Words inside 5-word windows that occur at least twice; windows are compared exactly."""
    n = len(words)
    if n <= WINDOW:
        return 0
    seen: dict[bytes, int] = {}
    one = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)

    def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.unique(a * n + b, return_inverse=True)[1].astype(np.int64)

    two = joined(one[:-1], one[1:])
    four = joined(two[:-2], two[2:])
    five = joined(four[:-1], one[WINDOW - 1 :])
    starts = np.flatnonzero(np.bincount(five)[five] > 1)
    cover = np.zeros(n + 1, np.int64)
    cover[starts] += 1
    cover[starts + WINDOW] -= 1
    return int((np.cumsum(cover) > 0).sum())


def measure(text: bytes) -> tuple[int, int, int, int, int, int]:
    words = text.split()  # bytes split at ASCII white space only
    packed = text.translate(None, WHITE)
    chars = len(packed) if packed.isascii() else len(packed.decode("utf-8"))
    symbols = len(packed) - len(packed.translate(None, SYMBOLS))
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(words), chars, symbols, len(lines), len(lines) - len(set(lines)), repeated_words(words)


@F.pandas_udf(T.StructType([T.StructField(name, T.LongType()) for name in MEASURES]))
def _metrics(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure(t) for t in texts], columns=list(MEASURES), dtype="int64")


def measured(docs: DataFrame, column: str = "text") -> DataFrame:
    """``docs`` with a struct ``__m`` of the base measures and ``__failed``, the fixed base rule. NULL text is empty."""
    small_batches(docs.sparkSession, mb=4)
    out = docs.withColumn("__m", _metrics(utf8(column)))
    failed = (F.col("__m.n_words") < 10) | (100 * F.col("__m.n_repeat_words") > 20 * F.col("__m.n_words"))
    return out.withColumn("__failed", failed)


def rate(over: str, under: str) -> Column:
    """Thousandths, rounded down; 0 where the denominator is 0."""
    return F.when(F.col(under) > 0, F.expr(f"(1000 * {over}) div {under}")).otherwise(F.lit(0)).cast("long")


def bucket(value: Column) -> Column:
    """Log-linear bucket of a non-negative long: exact below 256, then 7 leading bits (relative error under 1 %).

    Counts per bucket are the sketch: merging two of them is addition, so the order of merging and the
    layout of the data never change a quantile.
    """
    shift = F.greatest(F.length(F.bin(value)) - 8, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketches(rates: DataFrame, by: list[str]) -> DataFrame:
    """Bucket counts per group and rate: ``(*by, rate, value, n)``."""
    pairs = [F.struct(F.lit(name).alias("rate"), bucket(F.col(name)).alias("value")) for name, *_ in RATES]
    rows = rates.select(*by, F.explode(F.array(*pairs)).alias("p")).select(*by, "p.rate", "p.value")
    return rows.groupBy(*by, "rate", "value").agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of coarser groups, by adding those of the finer ones."""
    return sketch.groupBy(*by, "rate", "value").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame, by: list[str]) -> DataFrame:
    """One row per group: its document count and ``low_``/``high_`` limits for every rate.

    An upper limit of a one-sided rate climbs the quantiles of the group: from each, the next must lie within FENCE spreads
    of what has been passed. A group whose documents are of one kind, symbol-rich or not, is climbed to the upper quartile and
    gets its fence. In a group that is junk by 30 or 90 % the next quantile lies beyond a gap: the limit stays below it.

    The window holds the buckets of one group and rate: at most 256 plus 128 per further bit, whatever the data.
    """
    group = W.partitionBy(*by, "rate")
    ranked = sketch.withColumn("upto", F.sum("n").over(group.orderBy("value"))).withColumn("all", F.sum("n").over(group))

    def quantile(percent: int) -> Column:
        return F.min(F.when(F.col("upto") * 100 >= F.col("all") * percent, F.col("value"))).alias(f"q{percent}")

    steps = (0, *CLIMB, 25, 50, 75)
    quantiles = ranked.groupBy(*by, "rate").agg(*[quantile(p) for p in steps], F.max("all").alias("rows"))
    parts = [F.max("rows").alias("rows")]
    for name, _, _, least, lower in RATES:
        fence = lambda a, b: FENCE * F.greatest(F.col(f"q{b}") - F.col(f"q{a}"), F.lit(least))  # noqa: B023, E731
        high = F.col("q75") + fence(25, 75)
        if not lower:
            for last, step in reversed(list(zip(steps[1:], steps[2:]))):
                stop = F.col(f"q{last}") + fence(0, last)
                high = F.when(F.col(f"q{step}") > stop, stop).otherwise(high)
        here = F.col("rate") == name
        parts.append(F.max(F.when(here, high)).alias(f"high_{name}"))
        if lower:
            parts.append(F.max(F.when(here, F.col("q25") - fence(25, 75))).alias(f"low_{name}"))
    return quantiles.groupBy(*by).agg(*parts)


def thresholds(rates: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Limits per (lang, source), from its own sketch; small groups take those of the language, and these those of all rows."""
    finest = sketches(rates, ["lang", "source"])
    by_lang = merged(finest, ["lang"])
    whole = fences(merged(by_lang, []), [])
    limits = [c for c in whole.columns if c != "rows"]
    own = fences(finest, ["lang", "source"])
    lang = fences(by_lang, ["lang"]).select(F.col("lang").alias("__lang"), *[F.col(c).alias(f"__l_{c}") for c in ("rows", *limits)])
    last = whole.first()  # a single row
    out = own.join(lang, F.col("lang").eqNullSafe(F.col("__lang")), "left")

    def limit(c: str) -> Column:
        coarser = F.when(F.col("__l_rows") >= group_rows, F.col(f"__l_{c}")).otherwise(F.lit(last[c]))
        return F.when(F.col("rows") >= group_rows, F.col(c)).otherwise(coarser).cast("long").alias(c)

    return out.select("lang", "source", *[limit(c) for c in limits])


def limits_of(rows: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """The stored limits of measured rows; those that fail the base rule do not shape them."""
    rates = rows.where("NOT __failed").select("lang", "source", "__m")
    rates = rates.select("lang", "source", *[rate(f"__m.{over}", f"__m.{under}").alias(name) for name, over, under, *_ in RATES])
    return stored(thresholds(rates, group_rows), "limits")


def judged(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """Measured rows with ``__kept``: they pass the base rule and every limit of their language and source.

    A value equal to a limit passes. A missing ``lang`` or ``source`` is a group of its own. Repeated rows count as
    often as they occur and get the same verdict. An empty table gives an empty one.
    """
    named = limits.select(*[F.col(c).alias(f"__t_{c}") for c in limits.columns])
    both = F.col("lang").eqNullSafe(F.col("__t_lang")) & F.col("source").eqNullSafe(F.col("__t_source"))
    passes = ~F.col("__failed")
    for name, over, under, _, lower in RATES:
        value = rate(f"__m.{over}", f"__m.{under}")
        passes &= F.coalesce(value <= F.col(f"__t_high_{name}"), F.lit(True))
        if lower:
            passes &= F.coalesce(value >= F.col(f"__t_low_{name}"), F.lit(True))
    return rows.join(named, both, "left").withColumn("__kept", passes).drop(*named.columns)


def filter_documents(docs: DataFrame, group_rows: int = GROUP_ROWS, broadcast_rows: int = 1_000_000) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns; columns named like a measure stay as they are.

    Each text is measured once, into a stored table that holds it with its measures and a row number. Limits of at most
    ``broadcast_rows`` groups are sent to the rows, so no text is dealt out; more meet the narrow columns of the table,
    and the verdicts go back by row number. A text of any length is measured whole; NULL and empty ones fail the base rule.
    """
    whole = stored(measured(docs).withColumn("__row", F.monotonically_increasing_id()), "measured")
    narrow = whole.select("__row", "lang", "source", "__m", "__failed")
    limits = limits_of(narrow, group_rows)
    if within(limits, broadcast_rows):
        return judged(whole, F.broadcast(limits)).where("__kept").select(docs.columns)
    kept = judged(narrow, limits.hint("merge")).where("__kept").select("__row")
    return whole.join(kept.hint("merge"), "__row", "left_semi").select(docs.columns)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    narrow = stored(measured(docs).drop("text"), "measures")
    out = judged(narrow, small_side(limits_of(narrow)))
    base = [F.col(f"__m.{name}").alias(name) for name in MEASURES if name != "n_lines"]
    return out.select("doc_id", *base, F.col("__failed").alias("base_failed"), F.col("__kept").alias("kept"))
