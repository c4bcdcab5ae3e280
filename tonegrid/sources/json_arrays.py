"""JSON arrays of any length, read by byte range: many tasks share one file, and documents have ids of their place in it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.skew import small_side
from ..session import materialize, union_all

#: Bits of an id that hold the byte offset; those above hold the file's number.
OFFSET_BITS = 44

PLACED = "label string, file string, split long, value string, size long, quotes int, at long, parity int, start0 long, start1 long"


def _fragments(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Texts between closing brackets, with their bytes and unescaped quotes, in file order inside a split.

    Spark's text reader finds the fragments of a byte range by itself: a fragment belongs to the split it begins in.
    """
    parts = []
    for label, path in paths.items():
        rows = spark.read.text(path, lineSep="]")
        place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split")]
        parts.append(rows.select(F.lit(label).alias("label"), *place, "value"))
    bare = F.regexp_replace("value", r"\\.", "")
    quotes = F.length(bare) - F.length(F.replace(bare, F.lit('"'), F.lit("")))
    return union_all(*parts).select("*", (F.octet_length("value") + 1).cast("long").alias("size"), quotes.alias("quotes"))


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes and quotes (mod 2) before each fragment of its split; for either state at the split's start, where the text begins
    that the fragment belongs to (-1: before the split)."""
    name, at, parity, starts = None, 0, 0, [-1, -1]
    for batch in batches:
        splits = batch.column("split").to_pylist()
        files = batch.column("file").to_pylist()
        sizes, quotes = batch.column("size").to_pylist(), batch.column("quotes").to_pylist()
        out: list[tuple] = []
        for file, split, size, many in zip(files, splits, sizes, quotes):
            if (file, split) != name:
                name, at, parity, starts = (file, split), 0, 0, [-1, -1]
            starts[parity] = at  # outside a string if the split began in this state
            out.append((at, parity, *starts))
            at += size
            parity = (parity + many) % 2
        columns = np.array(out, np.int64).reshape(-1, 4).T
        added = [pa.array(columns[0]), pa.array(columns[1].astype(np.int32)), pa.array(columns[2]), pa.array(columns[3])]
        yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "at", "parity", "start0", "start1"])


def read_json_arrays(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """``(doc_id, label, tokens, file, offset)`` of JSON arrays of token arrays, ``paths`` by label.

    A file may hold one array of any length, or several one after another. ``offset`` is the byte at which the text of a
    document begins, behind the bracket that closes the one before; ``(file, offset)`` is unique. ``doc_id`` is the file's
    number, by label and path, above the offset: unique over all paths, in array order, whatever the splits. Brackets and quotes
    inside words are told apart by counting quotes, per split and then over the splits of a file. A NULL document is left
    out, an empty one is kept; an empty file and one that begins with an empty array of documents have none there.
    """
    rows = _fragments(spark, paths)
    key = ["label", "file", "split"]
    totals = rows.groupBy(*key).agg(F.sum("size").alias("size"), F.sum("quotes").alias("quotes"), F.max(F.col("quotes") % 2).alias("cut"))
    totals = materialize(totals)  # one row per split
    before = W.partitionBy("label", "file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    heads = totals.select(*key, zero("size").alias("ahead"), (zero("quotes") % 2).alias("state"))
    files = totals.select("label", "file").distinct()  # one row per file
    files = files.withColumn("number", F.row_number().over(W.orderBy("label", "file")) - 1)
    heads = materialize(heads.join(files, ["label", "file"]))
    placed = rows.mapInArrow(_places, PLACED).join(small_side(heads), key)
    open_ = (F.col("parity") + F.col("state")) % 2
    alone = (open_ == 0) & (F.col("quotes") % 2 == 0)
    fields = ["label", "file", "number", (F.col("ahead") + F.col("at")).alias("offset"), "value"]
    docs = placed.where(alone).select(*fields)
    if totals.agg(F.max("cut")).first()[0]:
        docs = union_all(docs, _joined(placed, heads, key))
    inner = F.regexp_extract("value", r"(?s)^(?:[\s,\[]|null)*\[(.*)$", 1)
    nothing = (F.col("offset") == 0) & F.regexp_like("value", F.lit(r"^\s*\[\s*$"))  # an array without documents
    docs = docs.where(F.regexp_like("value", F.lit(r"^(?:[\s,\[]|null)*\[")) & ~nothing)
    words = F.from_json(F.concat(F.lit("["), inner, F.lit("]")), "array<string>")
    doc_id = F.shiftleft(F.col("number").cast("long"), OFFSET_BITS) + F.col("offset")
    return docs.select(doc_id.alias("doc_id"), "label", words.alias("tokens"), "file", "offset")


def _joined(placed: DataFrame, heads: DataFrame, key: list[str]) -> DataFrame:
    """Documents with a closing bracket inside a word, put together from their fragments, also across splits."""
    start = F.when(F.col("state") == 0, F.col("start0")).otherwise(F.col("start1"))
    own = placed.withColumn("start", F.when(start >= 0, F.col("ahead") + start))
    last = own.groupBy(*key).agg(F.max("start").alias("last"))
    order = W.partitionBy("label", "file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)
    last = last.select(*key, F.last("last", ignorenulls=True).over(order).alias("last"))  # one row per split
    own = own.join(small_side(materialize(last)), key).withColumn("start", F.coalesce("start", "last"))
    # a fragment that neither begins nor ends in a word is a document by itself
    cut = own.where(((F.col("parity") + F.col("state")) % 2 == 1) | (F.col("quotes") % 2 == 1))
    pieces = cut.groupBy("label", "file", "number", "start").agg(F.sort_array(F.collect_list(F.struct("ahead", "at", "value"))).alias("p"))
    value = F.array_join(F.col("p.value"), "]")
    return pieces.select("label", "file", "number", F.col("start").alias("offset"), value.alias("value"))
