"""Joins, rankings and neighbour access that hold up when one key carries much of the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import raise_group_limit, union_all

# A key counts as hot when it holds more than 1/HOT_SLOTS of the rows, so at most
# HOT_SLOTS keys can be hot whatever the data.
HOT_SLOTS = 4096


def hot_keys(counted: DataFrame, count: str = "n", slots: int = HOT_SLOTS) -> DataFrame:
    """Rows of a (key, count) table whose count exceeds 1/slots of the sum: at most ``slots`` rows."""
    total = counted.agg(F.sum(count).alias("t")).scalar()
    return counted.where(F.col(count) * slots > total)


def lookup(
    left: DataFrame,
    table: DataFrame,
    on: list[str],
    values: list[str],
    hot: DataFrame,
    spread: Column,
    how: str = "left",
) -> DataFrame:
    """Left or inner join of ``left`` with ``table`` on ``on``, immune to hot keys.

    ``hot`` names the hot keys (at most ``HOT_SLOTS`` per group) and carries their values; it is
    broadcast. Rows it answers go into the shuffle join under a key made from ``spread``, which
    cannot match, so they are dealt out evenly; every other key is light by definition.
    ``values`` must not be NULL in ``table``, whose rows have keys of their own: a task hashes its even share of them, and
    ``left`` is not sorted.
    """
    small = hot.select(*on, *[F.col(v).alias(f"__hot_{v}") for v in values], F.lit(True).alias("__hot"))
    rest = table.select(
        *[F.col(k).alias(f"__{k}") for k in on],
        *[F.col(v).alias(f"__cold_{v}") for v in values],
        F.lit(False).alias("__is_hot"),
    )
    x = left.join(F.broadcast(small), on, "left")
    x = x.withColumn("__hot", F.coalesce("__hot", F.lit(False)))
    last = on[-1]
    x = x.withColumn("__key", F.when(F.col("__hot"), spread.cast("string")).otherwise(F.col(last).cast("string")))
    rest = rest.withColumn(f"__{last}", F.col(f"__{last}").cast("string"))
    match = [F.col(k) == F.col(f"__{k}") for k in on[:-1]]
    match += [F.col("__key") == F.col(f"__{last}"), F.col("__hot") == F.col("__is_hot")]
    x = x.join(rest.hint("shuffle_hash"), match, "left")
    if how == "inner":
        x = x.where(F.col("__hot") | F.col("__is_hot").isNotNull())
    return x.select(
        *left.columns,
        *[F.coalesce(f"__hot_{v}", f"__cold_{v}").alias(v) for v in values],
    )


def split_join(rows: DataFrame, table: DataFrame, key: str, hot_keys: DataFrame) -> DataFrame:
    """Inner join with a large table in two branches: hot keys by broadcast, the rest by shuffle.

    ``hot_keys`` names at most ``HOT_SLOTS`` keys, those that are frequent in ``rows`` whether ``table`` has them or
    not: a frequent key without a partner must not stay in the shuffle branch. The shuffle is asked for, since
    size estimates of exploded rows are far too low to choose a broadcast side by. Unlike ``lookup``, hot rows are
    never shuffled, which matters when the values are wide or the result is aggregated at once; the
    price is that ``rows`` is read twice.
    """
    frequent = F.broadcast(hot_keys.select(key))
    common = rows.join(F.broadcast(table.join(frequent, key, "left_semi")), key)
    rare = rows.join(frequent, key, "left_anti").join(table.hint("merge"), key)
    return union_all(common, rare)


def within(df: DataFrame, rows: int) -> bool:
    """Whether a table has at most ``rows`` rows (each partition sends one number)."""
    return df.count() <= rows


def small_side(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """Mark a narrow table for broadcast if it has at most ``rows`` rows.

    The size of a stored intermediate is unknown to the planner, which would shuffle the other side.
    """
    return F.broadcast(df) if within(df, rows) else df


def top_n(df: DataFrame, by: list[str], order: list[Column], n: int, fan_in: int = 64, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group with their rank, for few, very large groups.

    A first round keeps the best ``n`` per (group, task bundle), so no single task ever sees more
    than ``fan_in * n`` rows of a group. How rows fall into bundles does not affect the result.
    """
    raise_group_limit(df.sparkSession, n)
    bundled = df.withColumn("__b", F.spark_partition_id() % fan_in)
    first = W.partitionBy(*by, "__b").orderBy(*order)
    kept = bundled.withColumn("__r", F.row_number().over(first)).where(F.col("__r") <= n).drop("__b", "__r")
    last = W.partitionBy(*by).orderBy(*order)
    return kept.withColumn(rank, F.row_number().over(last)).where(F.col(rank) <= n)


def with_next(df: DataFrame, by: str, key: str, value: str, out: str, buckets: int = 512) -> DataFrame:
    """``lead(value)`` over (partition by ``by`` order by ``key``) without putting a group in one task.

    Rows are cut into ranges of ``key`` at its approximate quantiles; ``lead`` runs inside each
    range, and the last row of a range takes the first value of the next one (one row per range).
    """
    cuts = [i / buckets for i in range(1, buckets)]
    # fetched once, so that both uses below see the same cut points
    bounds = df.agg(F.percentile_approx(key, cuts)).first()[0] or []
    ranges = F.lit(bounds) if bounds else F.array()
    x = df.withColumn("__b", F.size(F.filter(ranges, lambda b: b <= F.col(key))))
    heads = x.groupBy(by, "__b").agg(F.min_by(value, key).alias("__head"))
    over = W.partitionBy(by).orderBy("__b")
    heads = heads.select(by, "__b", F.lead("__head").over(over).alias("__head"))
    inside = F.lead(value).over(W.partitionBy(by, "__b").orderBy(key))
    # at most `buckets` rows per group
    x = x.withColumn("__next", inside).join(F.broadcast(heads), [by, "__b"], "left")
    return x.select(*df.columns, F.coalesce("__next", "__head").alias(out))


def hash_key(column: Column, seed: int) -> Column:
    return F.md5(F.concat(column.cast("string"), F.lit(f"-{seed}")))


def hash_blocks(df: DataFrame, by: list[str], hashed: str, digits: int) -> DataFrame:
    """Rows per (group, first hex digits of the hash), with the rows before each block and in all."""
    block = F.substring(hashed, 1, digits).alias("__block")
    sizes = df.groupBy(*by, block).agg(F.count("*").alias("__n"))
    grouped = W.partitionBy(*by)
    before = grouped.orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    return sizes.select(
        *by,
        "__block",
        "__n",
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"),
        F.sum("__n").over(grouped).alias("__all"),
    )
