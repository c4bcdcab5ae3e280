"""Association and similarity formulas as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def chi_square(n_ii: Column, n_ix: Column, n_xi: Column, n_xx: Column) -> Column:
    """Pearson chi-square of a 2x2 table given one cell, both marginals and the total.

    Works in DOUBLE (squares of counts overflow BIGINT); NULL when a marginal is empty or full.
    """
    a = n_ii.cast("double")
    b = n_ix.cast("double") - a
    c = n_xi.cast("double") - a
    n = n_xx.cast("double")
    d = n - a - b - c
    diff = a * d - b * c
    margins = (a + b) * (a + c) * (b + d) * (c + d)
    return n * (diff * diff / F.nullif(margins, F.lit(0.0)))


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
