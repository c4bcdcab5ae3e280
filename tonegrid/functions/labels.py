"""Label expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..session import NEG, POS


def relabel(column: Column, old: str = "p", new: str = "n") -> Column:
    """``new`` where the value is ``old``; NULL everywhere else."""
    return F.when(column == old, F.lit(new))


def label_01(column: Column, positive: str = "p") -> Column:
    """1.0 for the positive value, 0.0 for anything else, NULL included."""
    return F.when(column == positive, 1.0).otherwise(0.0)


def class_name(flag: Column) -> Column:
    """``pos`` / ``neg`` from a 1 / 0 column."""
    return F.when(flag == 1, POS).otherwise(NEG)


def dense_features(columns: list[str]) -> Column:
    """Cast text columns to DOUBLE and collect them; bad numbers raise."""
    return F.array(*[F.col(c).cast("double") for c in columns])
