"""Preparation of rows for Spark ML fits."""

from __future__ import annotations

from pyspark.sql import DataFrame

ROWS_PER_TASK = 10_000


def training_rows(df: DataFrame) -> tuple[DataFrame, int]:
    """``(label, features)`` rows, persisted, and their number.

    Every optimiser step is a job over all partitions, so a small training set is packed into few.
    """
    rows = df.select("label", "features").persist()
    n = rows.count()
    few = max(1, n // ROWS_PER_TASK)
    if few >= rows.rdd.getNumPartitions():
        return rows, n
    packed = rows.repartition(few).persist()
    packed.count()
    rows.unpersist()
    return packed, n
