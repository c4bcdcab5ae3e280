"""Dictionary segmentation of text written without spaces."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import bounded_batches, released
from .skew import within

# A lexicon of at most this many words is shipped to the tasks (some 100 MB).
LEXICON_BROADCAST = 1_000_000

RUNS = r"[\p{L}\p{N}]+"
SPAN = "struct<start:int,shorter:int,token:string,flag:string>"


def _take_in_turn(spans: Column) -> Column:
    """Keep each span that begins at or after the end of the one kept before it."""
    none = F.struct(F.lit(0).alias("upto"), F.array().cast(f"array<{SPAN}>").alias("kept"))
    return F.aggregate(
        spans,
        none,
        lambda acc, s: F.when(
            s["start"] >= acc["upto"],
            F.struct((s["start"] - s["shorter"]).alias("upto"), F.concat(acc["kept"], F.array(s)).alias("kept")),
        ).otherwise(acc),
        lambda acc: acc["kept"],
    )


def walk(runs: list[str], flags: dict[str, str | None], lengths: dict[str, list[int]]) -> tuple[list, list, list, list]:
    """Runs, starts (from 1), words and flags of the longest matches from the left, in text order."""
    at_run, starts, tokens, found = [], [], [], []
    for number, run in enumerate(runs):
        i, last = 0, len(run) - 1
        while i < last:
            for n in lengths.get(run[i : i + 2], ()):
                token = run[i : i + n]
                if token in flags:
                    at_run.append(number)
                    starts.append(i + 1)
                    tokens.append(token)
                    found.append(flags[token])
                    i += len(token)
                    break
            else:
                i += 1
    return at_run, starts, tokens, found


def _walked(words: DataFrame, max_length: int | None):
    """A function from a text column to ``struct<run, start, token, flag>`` of arrays, for a lexicon of counted size."""
    flags = {r.token: r.flag for r in words.toLocalIterator() if max_length is None or len(r.token) <= max_length}
    sizes: dict[str, set[int]] = {}
    for token in flags:
        sizes.setdefault(token[:2], set()).add(len(token))
    lengths = {h: sorted(n, reverse=True) for h, n in sizes.items()}
    shared = words.sparkSession.sparkContext.broadcast((flags, lengths))
    bounded_batches(words.sparkSession)

    @F.pandas_udf("run array<int>, start array<int>, token array<string>, flag array<string>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = [walk([] if runs is None else runs, *shared.value) for runs in texts]
            yield pd.DataFrame(rows, columns=["run", "start", "token", "flag"], dtype=object)
        released()

    return lambda column: found(F.regexp_extract_all(F.col(column), F.lit(RUNS), F.lit(0)))


def _words(lexicon: DataFrame) -> DataFrame:
    return lexicon.where(F.length("token") > 1).groupBy("token").agg(F.max("flag").alias("flag"))


def segment(docs: DataFrame, lexicon: DataFrame, column: str = "text", max_length: int | None = None) -> DataFrame:
    """Left-to-right longest match against a lexicon: ``(doc_id, run, start, token, flag)``.

    Matches never cross anything but letters and digits, so text is cut into such runs first.
    Characters covered by no word are skipped. One-character words are left out: they advance the walk
    no further than a skipped character does. A NULL text has no words.

    A lexicon of counted small size is shipped to the tasks, which walk each text where it is. A larger one is
    joined by the first two characters of its words: a position becomes at most one row with its longest match.
    """
    words = _words(lexicon)
    if within(words, LEXICON_BROADCAST):
        rows = docs.select("doc_id", _walked(words, max_length)(column).alias("s")).select("doc_id", "s.*")
        each = rows.select("doc_id", F.explode(F.arrays_zip("run", "start", "token", "flag")).alias("k"))
        return each.select("doc_id", "k.run", "k.start", "k.token", "k.flag")
    if max_length is None:
        max_length = words.agg(F.max(F.length("token"))).first()[0] or 2
    entry = F.struct((-F.length("token")).alias("shorter"), "token", "flag")
    heads = words.groupBy(F.substring("token", 1, 2).alias("head")).agg(F.sort_array(F.collect_list(entry)).alias("words"))
    found = F.regexp_extract_all(F.col(column), F.lit(RUNS), F.lit(0))
    runs = docs.select("doc_id", F.posexplode(found).alias("run", "s"))
    starts = runs.select("doc_id", "run", "s", F.explode(F.sequence(F.lit(1), F.length("s"))).alias("start"))
    ahead = F.substring("s", F.col("start"), F.lit(max_length))
    starts = starts.select("doc_id", "run", "start", ahead.alias("ahead")).withColumn("head", F.substring("ahead", 1, 2))
    matches = F.filter("words", lambda w: F.startswith(F.col("ahead"), w["token"]))
    # size estimates ignore explode, so the side to broadcast is never left to them
    hits = starts.join(heads.hint("merge"), "head").select("doc_id", "run", "start", F.explode(F.slice(matches, 1, 1)).alias("w"))
    span = F.struct("start", "w.shorter", "w.token", "w.flag")
    per_run = hits.groupBy("doc_id", "run").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    kept = per_run.select("doc_id", "run", F.explode(_take_in_turn(F.col("spans"))).alias("k"))
    return kept.select("doc_id", "run", "k.start", "k.token", "k.flag")


def segmented(docs: DataFrame, lexicon: DataFrame, column: str = "text", flags=(), min_length: int = 2) -> DataFrame:
    """Rows with ``tokens`` from segmentation in place of the text; length and token-class filters applied.

    Rows without a match keep an empty array. No key column is needed: with a small lexicon a row stays where it
    is; with a large one rows are told apart by all their columns.
    """
    kept = [c for c in docs.columns if c != column]
    words = _words(lexicon)
    if within(words, LEXICON_BROADCAST):
        rows = docs.select(*kept, _walked(words, None)(column).alias("__s"))
        pairs = F.arrays_zip(F.col("__s.token").alias("token"), F.col("__s.flag").alias("flag"))
        wanted = lambda z: (F.length(z["token"]) >= min_length) & ~F.coalesce(z["flag"], F.lit("x")).isin(*flags)
        return rows.select(*kept, F.transform(F.filter(pairs, wanted), lambda z: z["token"]).alias("tokens"))
    keyed = docs.withColumn("__row", F.sha2(F.to_json(F.struct(*docs.columns)), 256))
    once = keyed.select(F.col("__row").alias("doc_id"), column).dropDuplicates(["doc_id"])
    rows = segment(once, lexicon, column).where(F.length("token") >= min_length)
    if flags:
        rows = rows.where(~F.coalesce("flag", F.lit("x")).isin(*flags))
    arrays = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("run", "start", "token"))).alias("__s"))
    joined = keyed.join(arrays.withColumnRenamed("doc_id", "__row"), "__row", "left")
    return joined.select(*kept, F.coalesce("__s.token", F.array().cast("array<string>")).alias("tokens"))
