"""Readers and writers for corpora, word lists, lexicons and vector tables.

Paths are passed to Spark as given, so any file system it knows works.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.labels import dense_features, label_01


def spread(scan: DataFrame, key: str) -> DataFrame:
    """Deal a small input out over all cores by ``key``; leave a large one as it was read.

    A small file often is a single row group, hence a single task. The exchange is only made when
    the scan has fewer splits than there are cores, so what it moves is bounded by cores x split size.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores, key)


def read_json_corpus(spark: SparkSession, path: str, label: str, whole_file: bool = True, across_files: bool = False) -> DataFrame:
    """A JSON array of token arrays per file: ``(doc_id, label, tokens)``.

    Ids are the place in the array, so they are unique in one file. With ``across_files`` they stand below a number
    made from label and file path: they then differ between files and classes as well (31-bit hash), follow array
    order, and do not depend on how files are split.

    A whole-file value is parsed by one task. Large corpora should hold one such array per line
    (``whole_file=False``), which Spark splits; ids are then only unique, not dense.
    """
    docs = F.from_json("value", "array<array<string>>")
    text = spark.read.text(path, wholetext=whole_file)
    rows = text.select(F.col("_metadata.file_path").alias("__file"), F.posexplode(docs).alias("doc_id", "tokens"))
    file = F.pmod(F.xxhash64(F.lit(label), "__file"), F.lit(1 << 31))
    place = F.shiftleft(file, 32) + F.col("doc_id") if across_files else F.col("doc_id").cast("long")
    doc_id = place if whole_file else F.monotonically_increasing_id()
    return rows.select(doc_id.alias("doc_id"), F.lit(label).alias("label"), "tokens")


def read_token_lines(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object ``{doc_id, label, tokens}`` per line; splits across tasks."""
    return spark.read.schema("doc_id BIGINT, label STRING, tokens ARRAY<STRING>").json(path)


def write_token_lines(docs: DataFrame, path: str) -> None:
    docs.select("doc_id", "label", "tokens").write.mode("overwrite").json(path)


def read_stopwords(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of words: distinct, empty ones dropped."""
    words = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("token"))
    return words.where("token <> ''").distinct()


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``word [frequency [flag]]``, blank-separated."""
    schema = "token STRING, freq BIGINT, flag STRING"
    return spark.read.schema(schema).csv(path, sep=" ", quote="", comment="").where("token IS NOT NULL")


def read_word_vectors_text(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``word v1 … vn``; a leading ``count width`` line is skipped."""
    parts = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p")).where(F.size("p") > 2)
    numbers = F.transform(F.slice("p", F.lit(2), F.size("p") - 1), lambda v: v.cast("float"))
    return parts.select(F.col("p")[0].alias("word"), numbers.alias("vec"))


def dense_schema(width: int = 400) -> T.StructType:
    fields = [T.StructField("label", T.StringType())]
    return T.StructType(fields + [T.StructField(f"v{i}", T.DoubleType()) for i in range(1, width + 1)])


def read_dense_csv(spark: SparkSession, path: str, width: int = 400, header: bool = True) -> DataFrame:
    """Label in column 0 and ``width`` numbers after it; malformed rows raise."""
    return spark.read.schema(dense_schema(width)).csv(path, header=header, mode="FAILFAST")


def write_dense_csv(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.mode("overwrite").csv(path, header=header)


def dense_rows(df: DataFrame, positive: str = "p") -> DataFrame:
    """``(label DOUBLE, features ARRAY<DOUBLE>)`` from the wide form."""
    first, *rest = df.columns
    return df.select(label_01(F.col(first), positive).alias("label"), dense_features(rest).alias("features"))
