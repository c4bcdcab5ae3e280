"""Linear models whose vocabulary and coefficients are tables, for corpora with more words than a driver should hold.

Words get ids in word order. Documents lie in blocks: rows of ids into the block's own vocabulary. All weights that a fit can
reach are sums over documents, so a direction is one number per document, and what it does to the margins another. A pass adds
up, by parts of the vocabulary (ranges of ids), what the gradient's numbers give the words, and answers each block with the
sums of its own words; words of a single block stay there. The loss is then minimised by Newton steps over the gradient and the
last steps together (Narkiss and Zibulevsky 2005), which reads one row per block and needs no pass. What reaches the driver are
sums; it does not grow with the vocabulary or the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.presence import weight_sums
from ..session import POS, bounded_batches, delete, materialize, scratch_path

#: Documents of a block, and presences.
BLOCK_ROWS, BLOCK_CELLS = 20_000, 1 << 20
#: Partitions of the blocks at most.
DEALT = 2048
#: Words of a part of the vocabulary.
PART = 1 << 16
#: Last steps that are taken into the next one.
MEMORY = 20
#: Newton steps between two passes.
INNER = {"logistic": 2, "hinge": 4}
#: Step lengths that are tried at once.
STEPS = np.array([2.0**-k for k in range(-3, 13)])

#: The hinge is rounded by a parabola on this stretch before its corner, so that it has a gradient everywhere.
ROUNDED = 0.1

LOSSES = ("logistic", "hinge")


class Store:
    """Parquet tables of one fit, below the shared folder; ``close`` deletes them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, scratch_path(spark, "fit"), 0

    def __call__(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        delete(self.spark, self.root)


def word_index(words: DataFrame, store: Store) -> DataFrame:
    """``(word, id)``: distinct words, numbered from 0 in word order by ranges, each range by its own task."""
    ranged = words.select("word").distinct().repartitionByRange("word").sortWithinPartitions("word")
    rows = store(ranged.select("word", F.monotonically_increasing_id().alias("at")))
    sizes = rows.groupBy(F.shiftright("at", 33).alias("range")).agg(F.count("*").alias("n")).orderBy("range").collect()
    before = np.cumsum([0, *[r.n for r in sizes]])[:-1].tolist()
    starts = rows.sparkSession.createDataFrame([(r["range"], b) for r, b in zip(sizes, before)], "range long, before long")
    at = rows.withColumn("range", F.shiftright("at", 33)).join(F.broadcast(starts), "range")  # one row per range
    return at.select("word", (F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("id"))


BODY = "block long, y binary, starts binary, cells binary, words array<string>"


def _blocks(batches: Iterator[pd.DataFrame], rows: int, cells: int) -> Iterator[pd.DataFrame]:
    """Documents as rows of places in the block's vocabulary, that is listed in order of appearance."""
    number = TaskContext.get().partitionId() << 32
    seen: dict[str, int] = {}
    y, sizes, held = [], [], []

    def flush() -> pd.DataFrame:
        starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        one = (number, np.array(y).tobytes(), starts.tobytes(), np.array(held, np.int64).tobytes(), list(seen))
        return pd.DataFrame([one], columns=["block", "y", "starts", "cells", "words"])

    for batch in batches:
        for label, words in zip(batch["y"], batch["words"]):
            own = [] if words is None else words
            held += [seen.setdefault(w, len(seen)) for w in own]
            y.append(label)
            sizes.append(len(own))
            if len(y) >= rows or len(held) >= cells:
                yield flush()
                number, seen, y, sizes, held = number + 1, {}, [], [], []
    if y:
        yield flush()


INDEXED = "block long, y binary, starts binary, cells binary, ids binary, shared long"


def _indexed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks over the ids of their words: those that other blocks have too in ascending order, then the rest; words without
    an id are left out."""
    for batch in batches:
        out = []
        for r in batch.itertuples(index=False):
            at = np.full(r.many, -1, np.int64)
            ids = np.array([] if r.known is None else r.known, np.int64)
            at[np.array([] if r.places is None else r.places, np.int64)] = np.arange(len(ids))
            cells, starts = at[_numbers(r.cells, np.int64)], _numbers(r.starts, np.int64)
            kept = np.concatenate([[0], np.cumsum(cells >= 0)])[starts]
            out.append((r.block, r.y, kept.tobytes(), cells[cells >= 0].astype(np.int32).tobytes(), ids.tobytes(), 0 if np.isnan(r.shared) else int(r.shared)))
        yield pd.DataFrame(out, columns=["block", "y", "starts", "cells", "ids", "shared"])


def blocks_of(docs: DataFrame, index: DataFrame | None, store: Store, rows: int = BLOCK_ROWS, cells: int = BLOCK_CELLS):
    """Blocks of ``docs`` (label, tokens), and the index ``(word, id)`` that they refer to."""
    sets = docs.select(F.when(F.col("label") == POS, 1.0).otherwise(-1.0).alias("y"), F.array_distinct("tokens").alias("words"))
    bodies = store(sets.mapInPandas(lambda batches: _blocks(batches, rows, cells), BODY))
    listed = bodies.select("block", F.posexplode("words").alias("place", "word"))
    index = store(word_index(listed if index is None else index, store))
    alone = F.count("*").over(W.partitionBy("word")) == 1  # a word has one row per block
    named = listed.join(index.hint("merge"), "word").select("block", alone.alias("alone"), "id", "place")
    known = named.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("alone", "id", "place"))).alias("k"), F.count_if(~F.col("alone")).alias("shared"))
    known = known.select("block", F.col("k.id").alias("known"), F.col("k.place").alias("places"), "shared")
    bodies = bodies.withColumn("many", F.size("words")).drop("words").join(known.hint("merge"), "block", "left")
    return store(bodies.mapInPandas(_indexed, INDEXED)), index


def slope(margin: np.ndarray, y: np.ndarray, loss: str) -> np.ndarray:
    """Derivative of a document's loss by its margin."""
    signed = margin * y
    if loss == "logistic":
        return -y / (1 + np.exp(np.clip(signed, -700, 700)))
    return -y * np.clip((1 - signed) / ROUNDED, 0, 1)


def losses(margin: np.ndarray, y: np.ndarray, loss: str) -> float:
    signed = margin * y
    if loss == "logistic":
        return float(np.logaddexp(0, -signed).sum())
    short = np.maximum(0, 1 - signed)
    return float(np.where(short < ROUNDED, short**2 / (2 * ROUNDED), short - ROUNDED / 2).sum())


def bend(margin: np.ndarray, y: np.ndarray, loss: str) -> np.ndarray:
    """Second derivative of a document's loss by its margin; for the hinge, that of a parabola which follows it further."""
    signed = margin * y
    if loss == "logistic":
        p = 1 / (1 + np.exp(np.clip(signed, -700, 700)))
        return p * (1 - p)
    return 1 / (8 * np.maximum(np.abs(1 - signed - ROUNDED / 2), 2 * ROUNDED))


def _numbers(data, dtype=np.float64) -> np.ndarray:
    return np.frombuffer(b"" if data is None else data, dtype)


@dataclass
class Step:
    """Shares of the directions kept so far, of the constant, and how many of the oldest directions go afterwards."""

    shares: np.ndarray
    constant: float
    drop: int


def _moved(r, step: Step | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """After the step: a document's share in the weights, its margin, and for each direction that is kept, the shares and what
    it does to the margins."""
    n = len(r.y) // 8
    if step is None:
        return np.zeros(n), np.zeros(n), np.zeros((0, n)), np.zeros((0, n))
    along, changes = (_numbers(v).reshape(-1, n) for v in (r.along, r.changes))
    move, change = step.shares @ along, step.shares @ changes
    kept = slice(step.drop, len(along) - 1)  # the last one was the gradient
    margin = _numbers(r.margin) + change + step.constant
    return _numbers(r.coef) + move, margin, np.vstack([along[kept], move]), np.vstack([changes[kept], change])


def _summed(r, values: np.ndarray, words: int) -> np.ndarray:
    """Sums of the documents' values for each word of a block."""
    return np.bincount(_numbers(r.cells, np.int32), np.repeat(values, np.diff(_numbers(r.starts, np.int64))), words)


def _by_part(ids: np.ndarray, part: int) -> Iterator[tuple[int, int, int]]:
    """Parts of ascending ids, with the places they begin and end at."""
    parts, first = np.unique(ids // part, return_index=True)
    yield from zip(parts.tolist(), first.tolist(), [*first[1:].tolist(), len(ids)])


SENT = "part long, block long, ids binary, values binary"


def _pushed(batches: Iterator[pd.DataFrame], loss: str, step: Step | None, penalty: float, n: int, part: int) -> Iterator[pd.DataFrame]:
    """What the gradient after the step gives those words of a block that other blocks have too, by parts."""
    for batch in batches:
        for r in batch.itertuples(index=False):
            coef, margin, _, _ = _moved(r, step)
            ids = _numbers(r.ids, np.int64)
            values = _summed(r, slope(margin, _numbers(r.y), loss) / n + penalty * coef, len(ids))
            ids = ids[: r.shared]
            out = [(p, r.block, (ids[a:b] - p * part).astype(np.int32).tobytes(), values[a:b].tobytes()) for p, a, b in _by_part(ids, part)]
            yield pd.DataFrame(out, columns=["part", "block", "ids", "values"])


def _answered(batches: Iterator[pd.DataFrame], part: int) -> Iterator[pd.DataFrame]:
    """The sums over all blocks of what a part's words were given, for the words of each block."""
    for batch in batches:
        for r in batch.itertuples(index=False):
            sums = _total(r.pushed, part)
            out = [(p["block"], r.part, sums[_numbers(p["ids"], np.int32)].tobytes()) for p in r.pushed]
            yield pd.DataFrame(out, columns=["block", "part", "values"])


def _total(pushed, size: int) -> np.ndarray:
    sums = np.zeros(size)
    for p in pushed:
        sums[_numbers(p["ids"], np.int32)] += _numbers(p["values"])
    return sums


STATE = "block long, y binary, coef binary, margin binary, along binary, changes binary, sums array<double>"


def _met(batches: Iterator[pd.DataFrame], loss: str, step: Step | None, bias: float, penalty: float, n: int) -> Iterator[pd.DataFrame]:
    """Blocks after the step with the gradient as their last direction; and the loss, its derivatives along the directions and
    the constant, the product of the weights with themselves and with the directions, and those of the directions."""
    for batch in batches:
        out = []
        for r in batch.itertuples(index=False):
            coef, margin, along, changes = _moved(r, step)
            y = _numbers(r.y)
            push = slope(margin, y, loss) / n + penalty * coef
            own = _summed(r, push, r.many)
            own[: r.shared] = np.concatenate([_numbers(b""), *[_numbers(p["values"]) for p in ([] if r.pulled is None else r.pulled)]])
            starts = _numbers(r.starts, np.int64)
            reached = np.bincount(np.repeat(np.arange(len(y)), np.diff(starts)), own[_numbers(r.cells, np.int32)], len(y))
            along, changes = np.vstack([along, push]), np.vstack([changes, reached])
            sums = [*_derivatives(margin, y, changes, loss), coef @ (margin - bias), *(changes @ coef), *(along @ changes.T).ravel()]
            out.append((r.block, r.y, coef.tobytes(), margin.tobytes(), along.tobytes(), changes.tobytes(), sums))
        yield pd.DataFrame(out, columns=["block", "y", "coef", "margin", "along", "changes", "sums"])


def _derivatives(margin: np.ndarray, y: np.ndarray, changes: np.ndarray, loss: str) -> np.ndarray:
    """The loss, its first and its second derivatives along the directions and the constant."""
    both = np.vstack([changes, np.ones(len(y))])
    return np.concatenate([[losses(margin, y, loss)], both @ slope(margin, y, loss), ((both * bend(margin, y, loss)) @ both.T).ravel()])


def _probed(batches: Iterator[pd.DataFrame], loss: str, at: np.ndarray, move: np.ndarray) -> Iterator[pd.DataFrame]:
    """The loss for each step length along ``move`` from ``at``, and the derivatives at its end."""
    sums = np.zeros(0)
    for batch in batches:
        for r in batch.itertuples(index=False):
            y = _numbers(r.y)
            changes = _numbers(r.changes).reshape(-1, len(y))
            margin, change = (t[:-1] @ changes + t[-1] for t in (at, move))
            margin = margin + _numbers(r.margin)
            tried = [losses(margin + t * change, y, loss) for t in STEPS]
            found = np.concatenate([tried, _derivatives(margin + change, y, changes, loss)])
            sums = found if not len(sums) else sums + found
    if len(sums):
        yield pd.DataFrame([(sums,)], columns=["sums"])


def _totals(rows: DataFrame, size: int) -> np.ndarray:
    """Sums of the arrays in ``sums``, place by place."""
    out = np.zeros(size)
    for r in rows.select(F.posexplode("sums").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[r["at"]] = r.v
    return out


def _weights(batches: Iterator[pd.DataFrame], part: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for r in batch.itertuples(index=False):
            yield pd.DataFrame({"id": r.part * part + np.arange(part), "w": _total(r.pushed, part)})


def _shares(batches: Iterator[pd.DataFrame], part: int) -> Iterator[pd.DataFrame]:
    """What the documents give the words of a block, by parts."""
    for batch in batches:
        for r in batch.itertuples(index=False):
            ids = _numbers(r.ids, np.int64)
            values = _summed(r, _numbers(r.coef), len(ids))
            order = np.argsort(ids)
            ids, values = ids[order], values[order]
            out = [(p, r.block, (ids[a:b] - p * part).astype(np.int32).tobytes(), values[a:b].tobytes()) for p, a, b in _by_part(ids, part)]
            yield pd.DataFrame(out, columns=["part", "block", "ids", "values"])


def newton(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The step to the minimum of a parabola; directions that the others nearly give are left alone."""
    scale = 1 / np.sqrt(np.maximum(np.diag(second), 1e-300))
    values, vectors = np.linalg.eigh(second * scale * scale[:, None])
    sound = values > 1e-12 * values.max()
    return -scale * (vectors[:, sound] @ ((vectors[:, sound].T @ (scale * first)) / values[sound]))


def direction(gram: np.ndarray, pairs: int) -> np.ndarray:
    """Coefficients of the quasi-Newton direction over (s1 …, y1 …, g), from their inner products alone."""
    q = np.zeros(2 * pairs + 1)
    q[-1] = -1.0
    alpha = np.zeros(pairs)
    for i in reversed(range(pairs)):
        alpha[i] = (q @ gram[:, i]) / gram[i, pairs + i]
        q[pairs + i] -= alpha[i]
    if pairs:
        q *= gram[pairs - 1, 2 * pairs - 1] / gram[2 * pairs - 1, 2 * pairs - 1]
    for i in range(pairs):
        q[i] += alpha[i] - (q @ gram[:, pairs + i]) / gram[i, pairs + i]
    return q


@dataclass
class TableLinearModel:
    """``margin = bias + sum of the weights of a document's distinct words``; positive above 0."""

    weights: DataFrame  # feature, w
    bias: float
    size: int
    #: Iterations, loss, and length of the gradient at the end and at the start.
    report: dict

    def transform(self, docs: DataFrame) -> DataFrame:
        """The columns of ``docs`` but ``tokens``, which must identify the row, plus ``margin`` and ``prediction``."""
        summed = weight_sums(docs, self.weights, ["w"], self.size)
        margin = F.coalesce("w", F.lit(0.0)) + F.lit(self.bias)
        return summed.withColumn("margin", margin).drop("w").withColumn("prediction", (F.col("margin") > 0).cast("double"))


def fit_linear(
    docs: DataFrame,
    words: DataFrame | None = None,
    loss: str = "logistic",
    penalty: float | None = None,
    tolerance: float = 1e-4,
    gain: float = 1e-9,
    most: int = 100,
    rows: int = BLOCK_ROWS,
    cells: int = BLOCK_CELLS,
    part: int = PART,
) -> TableLinearModel:
    """Mean loss plus ``penalty`` / 2 times the squared weights (1 / documents if None; the constant is free), minimised.

    ``docs`` has ``label`` and ``tokens``; ``words`` (word) restricts the vocabulary. Ends when the gradient is ``tolerance``
    times its first length, when a step improves the loss by less than a share of ``gain``, or after ``most`` iterations.
    """
    spark = docs.sparkSession
    store = Store(spark)
    bounded_batches(spark, mb=8)  # a block or a part is a row of some MB
    blocks, index = blocks_of(docs, words, store, rows, cells)
    labels, many = blocks.agg(F.sum(F.octet_length("y")), F.count("*")).first()
    n = (labels or 0) // 8
    penalty = 1.0 / max(n, 1) if penalty is None else penalty
    # a number of its own, so that what is kept lies as the states are dealt; else every pass would deal the blocks anew
    deal = lambda df: df.repartition(min(max(many, 1), DEALT), "block")
    held = deal(blocks).sortWithinPartitions("block").persist(StorageLevel.DISK_ONLY)
    try:
        return _descend(held, index, store, loss, penalty, tolerance, gain, most, max(n, 1), part, deal)
    finally:
        held.unpersist()
        store.close()


def _descend(blocks, index, store, loss, penalty, tolerance, gain, most, n, part, deal) -> TableLinearModel:
    spark = index.sparkSession

    def sent(joined: DataFrame, values) -> DataFrame:
        rows = joined.mapInPandas(values, SENT).groupBy("part")
        return rows.agg(F.sort_array(F.collect_list(F.struct("block", "ids", "values"))).alias("pushed"))

    def passed(state: DataFrame | None, step: Step | None, bias: float) -> DataFrame:
        """The blocks after a step, with the gradient there and what it does to the margins."""
        if state is None:
            none = F.lit(None).cast("binary")
            joined = blocks.select("*", *[none.alias(c) for c in ("coef", "margin", "along", "changes")])
        else:
            joined = blocks.join(deal(state.select("block", "coef", "margin", "along", "changes")).hint("merge"), "block")
        pushed = sent(joined, lambda batches: _pushed(batches, loss, step, penalty, n, part))
        pulled = deal(pushed.mapInPandas(lambda batches: _answered(batches, part), "block long, part long, values binary")).groupBy("block")
        pulled = pulled.agg(F.sort_array(F.collect_list(F.struct("part", "values"))).alias("pulled"))
        met = joined.withColumn("many", F.octet_length("ids") / 8).withColumn("many", F.col("many").cast("long")).drop("ids")
        met = met.join(pulled.hint("merge"), "block", "left")
        return store(met.mapInPandas(lambda batches: _met(batches, loss, step, bias, penalty, n), STATE))

    state, bias, kept, first = passed(None, None, 0.0), 0.0, 0, None
    report = {"iterations": 0}
    while True:
        size = kept + 2  # the last steps, the gradient and the constant
        derived = 1 + size + size * size
        sums = _totals(state, derived + 1 + (size - 1) + (size - 1) ** 2)
        own, with_weights, products = np.split(sums[derived:], [1, size])
        with_weights, products = np.append(with_weights, 0.0), np.pad(products.reshape(size - 1, -1), (0, 1))

        def value(tried: float, t: np.ndarray) -> float:
            return tried / n + penalty / 2 * (own[0] + 2 * with_weights @ t + t @ products @ t)  # noqa: B023

        at, slopes, bends = np.zeros(size), *np.split(sums[1:derived], [size])
        before = now = value(sums[0], at)
        length = float(np.sqrt(max(products[-2, -2], 0.0) + (slopes[-1] / n) ** 2))
        first = length if first is None else first
        report |= {"gradient": length, "first": first, "loss": float(before)}
        if length <= tolerance * first or report["iterations"] >= most:
            break
        for _ in range(INNER[loss]):
            move = newton(slopes / n + penalty * (with_weights + products @ at), bends.reshape(size, size) / n + penalty * products)
            probed = state.select("y", "margin", "changes").mapInPandas(lambda batches: _probed(batches, loss, at, move), "sums array<double>")  # noqa: B023
            found = _totals(probed, len(STEPS) + derived)
            reached = [value(v, at + t * move) for v, t in zip(found, STEPS)]
            best = int(np.argmin(reached))
            if reached[best] >= now:
                break
            at, now = at + STEPS[best] * move, reached[best]
            if STEPS[best] != 1.0:
                break  # the derivatives are known for a step of length 1
            slopes, bends = np.split(found[len(STEPS) + 1 :], [size])
        if before - now < gain * abs(before) or now >= before:
            break
        drop = 1 if kept == MEMORY else 0
        kept, bias = kept + 1 - drop, bias + float(at[-1])
        state = passed(state, Step(at[:-1], float(at[-1]), drop), bias)
        report["iterations"] += 1
    path = scratch_path(spark, "weights")
    values = sent(blocks.join(deal(state.select("block", "coef")).hint("merge"), "block"), lambda batches: _shares(batches, part))
    values = values.mapInPandas(lambda batches: _weights(batches, part), "id long, w double")
    index.join(values.hint("merge"), "id", "left").select(F.col("word").alias("feature"), F.coalesce("w", F.lit(0.0)).alias("w")).write.parquet(path)
    weights = spark.read.parquet(path)
    return TableLinearModel(weights, bias, weights.count(), report)


def gradient_length(model: TableLinearModel, docs: DataFrame, penalty: float, loss: str = "logistic") -> float:
    """Length of the objective's gradient at ``model``, from its word table by joins; independent of the fit."""
    scored = materialize(model.transform(docs.select("doc_id", "label", "tokens")).select("doc_id", "label", "margin"))
    y = F.when(F.col("label") == POS, 1.0).otherwise(-1.0)
    signed = y * F.col("margin")
    push = -y / (1.0 + F.exp(signed)) if loss == "logistic" else -y * F.least(F.greatest((1.0 - signed) / ROUNDED, F.lit(0.0)), F.lit(1.0))
    n = scored.count()
    # joined before the words are listed, so that a document travels once and its words are added up where it lies
    rows = docs.select("doc_id", "tokens").join(scored.select("doc_id", push.alias("push")).hint("merge"), "doc_id")
    sums = rows.select("push", F.explode(F.array_distinct("tokens")).alias("feature")).groupBy("feature").agg(F.sum("push").alias("p")).join(model.weights.hint("merge"), "feature")
    part = F.col("p") / n + penalty * F.col("w")
    squares = sums.agg(F.sum(part * part)).first()[0] or 0.0
    constant = (scored.agg(F.sum(push)).first()[0] or 0.0) / n
    return float(np.sqrt(squares + constant**2))
