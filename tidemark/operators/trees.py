"""Boosted trees on binned features: absolute loss, log loss, and LambdaRank within dates.

Rows stay where they are: each level of a tree is one aggregation of gradients and Hessians by (node, feature,
bin), which every task adds up for its own rows first, and the driver sees nodes x features x bins sums. Gradients
are rounded to 2 ^ -20 and added up as integers, so sums, splits and trees don't depend on the order of rows or
on which task is run again. A round ends with the rows written with their new scores and gradients.

LambdaRank takes the pairs of a date of which one is among its TOP rows by score. The ranking by score sorts a date's
rows in one task, and the pairs are taken in the same pass, batch by batch against the top rows at its head, so no pair is
a row, and a task holds a batch and TOP rows of a date besides what it sorts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.operators.evaluate import quantiles
from tidemark.sources.stages import dealt, written

#: Gradients are integers of this many to one.
UNIT = float(1 << 20)
#: Rows of a date whose pairs count.
TOP = 30
#: Rows whose pairs are taken at a time.
STEP = 1024


@dataclass(frozen=True)
class Settings:
    rounds: int = 120
    rate: float = 0.04
    depth: int = 5
    leaves: int = 15
    least: int = 200
    l1: float = 1.0
    l2: float = 5.0
    feature_fraction: float = 0.8
    positive_weight: float = 1.0
    bins: int = 64
    seed: int = 42


@dataclass
class Tree:
    """Nodes by place (children of i: 2i + 1, 2i + 2): the feature and highest bin that goes left, or -1 and a value."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @classmethod
    def stump(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1), np.zeros(n, int), np.zeros(n))

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        at = np.zeros(len(bins), int)
        while True:
            split = self.feature[at]
            go = np.flatnonzero(split >= 0)
            if not len(go):
                return at
            right = bins[go, split[go]] > self.cut[at[go]]
            at[go] = 2 * at[go] + 1 + right


@dataclass
class Boosted:
    features: tuple[str, ...]
    edges: tuple[tuple[float, ...], ...]
    base: float
    rate: float
    trees: list[Tree] = field(default_factory=list)
    gains: np.ndarray | None = None

    def binned(self, x: np.ndarray) -> np.ndarray:
        """Bin of each value: 0 for none, then one more than the edges below it."""
        out = np.zeros(x.shape, np.uint8)
        for f, edges in enumerate(self.edges):
            known = ~np.isnan(x[:, f])
            out[known, f] = np.searchsorted(np.array(edges), x[known, f], "left") + 1
        return out

    def scores(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.base)
        for t in self.trees:
            out += self.rate * t.value[t.leaf_of(bins)]
        return out

    def column(self) -> Column:
        """The score of a row."""

        @F.pandas_udf("double")
        def run(x: pd.Series) -> pd.Series:
            return pd.Series(self.scores(self.binned(np.array(x.tolist(), float))) if len(x) else [], dtype=float)

        return run(F.array(*(F.col(c).cast("double") for c in self.features)))

    def importance(self) -> dict[str, float]:
        """Each feature's share of all splits."""
        n = np.bincount(np.concatenate([t.feature[t.feature >= 0] for t in self.trees] or [np.zeros(0, int)]), minlength=len(self.features))
        return {f: float(v / max(n.sum(), 1)) for f, v in zip(self.features, n, strict=True)}


def _soft(g: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def best_splits(hist: np.ndarray, usable: np.ndarray, s: Settings) -> list[tuple[float, int, int] | None]:
    """The best (gain, feature, highest bin to the left) of each node, if any gains. hist: nodes x features x bins x (gradient, Hessian, rows)."""
    left = hist.cumsum(2)
    whole = left[:, :, -1:, :]
    right = whole - left
    worth = lambda x: _soft(x[..., 0], s.l1) ** 2 / (x[..., 1] + s.l2 + 1e-12)
    gain = worth(left) + worth(right) - worth(whole)
    gain[(left[..., 2] < s.least) | (right[..., 2] < s.least)] = 0.0
    gain[:, ~usable] = 0.0
    out: list[tuple[float, int, int] | None] = []
    for g in np.round(gain, 9):
        f, b = np.unravel_index(int(g.argmax()), g.shape)
        out.append((float(g[f, b]), int(f), int(b)) if g[f, b] > 1e-9 else None)
    return out


def histogram(rows: DataFrame, tree: Tree, nodes: list[int], features: int, bins: int) -> np.ndarray:
    """Sums of gradient, Hessian and rows by node, feature and bin. rows: bins, g, h."""
    place = np.full(len(tree.feature), -1)
    place[nodes] = np.arange(len(nodes))
    size = len(nodes) * features * bins

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, size))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(0), features)
            at = place[tree.leaf_of(x)]
            own = at >= 0
            key = ((at[own, None] * features + np.arange(features)[None, :]) * bins + x[own]).ravel()
            for i in range(2):
                total[i] += np.bincount(key, np.repeat(batch.column(i + 1).to_numpy()[own].astype(float), features), size)
            total[2] += np.bincount(key, minlength=size)
        used = np.flatnonzero(total[2])
        yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(total[i, used].astype(np.int64)) for i in range(3))], ["at", "g", "h", "n"])

    sums = rows.select("bins", "g", "h").mapInArrow(run, "at long, g long, h long, n long").groupBy("at").agg(F.sum("g"), F.sum("h"), F.sum("n"))
    out = np.zeros((size, 3))
    for at, g, h, n in sums.collect():  # nodes x features x bins
        out[at] = g / UNIT, h / UNIT, n
    return out.reshape(len(nodes), features, bins, 3)


def _matrix(column: pa.Array, features: int) -> np.ndarray:
    """Bins of rows, from the column's own bytes: every value has as many."""
    _, offsets, data = column.buffers()
    first = np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset]
    return np.frombuffer(data, np.uint8)[first : first + len(column) * features].reshape(-1, features)


def grow(rows: DataFrame, features: int, bins: int, usable: np.ndarray, s: Settings) -> Tree:
    """A tree level by level; of the splits of a level the best go first until there are as many leaves as allowed."""
    tree = Tree.stump(s.depth)
    nodes, leaves = [0], 1
    for level in range(s.depth + 1):
        hist = histogram(rows, tree, nodes, features, bins)
        for node, h in zip(nodes, hist, strict=True):
            g, w = h[0].sum(0)[:2]
            tree.value[node] = -_soft(g, s.l1) / (w + s.l2 + 1e-12)
        if level == s.depth:
            break
        found = [(x, node) for x, node in zip(best_splits(hist, usable, s), nodes, strict=True) if x]
        found = sorted(found, key=lambda x: (-x[0][0], x[1]))[: max(0, s.leaves - leaves)]
        if not found:
            break
        leaves += len(found)
        for (_, f, b), node in found:
            tree.feature[node], tree.cut[node] = f, b
        nodes = sorted(c for _, node in found for c in (2 * node + 1, 2 * node + 2))
    return tree


def _edges(train: DataFrame, features: Sequence[str], bins: int) -> tuple[tuple[float, ...], ...]:
    """Up to bins - 2 edges of each feature: quantiles of its values, each once."""
    out = []
    for c in features:
        r = quantiles(train, c, [k / (bins - 1) for k in range(1, bins - 1)]).first()
        out.append(tuple(sorted({float(v) for v in (r.q if r else []) if v is not None})))
    return tuple(out)


def fit(train: DataFrame, features: Sequence[str], label: str, objective: str, settings: Settings, date: str | None = None, key: str | None = None) -> Boosted:
    """Trees for ``l1`` (a number), ``binary`` (0 or 1) or ``lambdarank`` (relevance 0, 1, ... within ``date``, ties of scores by ``key``).

    Rows without a label take no part; null and NaN features go by a bin of their own. A training table without rows
    raises an error. Settings' defaults are those of relevance ranking.
    """
    s, names = settings, list(features)
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c)
    extra = [F.col(date).alias("__date"), F.col(key).alias("__key")] if objective == "lambdarank" else []
    rows = written(train.where(F.col(label).isNotNull()).select(*map(number, names), F.col(label).cast("double").alias("__y"), *extra), "trees-rows")
    first = rows.agg(F.count("*").alias("n"), F.avg("__y").alias("mean")).first()
    if not first["n"]:
        raise ValueError("no rows to fit")
    base = 0.0
    if objective == "l1":
        base = float(quantiles(rows, "__y", [0.5]).first().q[0])
    elif objective == "binary":
        weight = s.positive_weight * first["mean"]
        rate = min(max(weight / (weight + 1 - first["mean"]), 1e-9), 1 - 1e-9)
        base = float(np.log(rate / (1 - rate)))
    model = Boosted(tuple(names), _edges(rows, names, s.bins), base, s.rate)

    @F.pandas_udf("binary")
    def to_bins(x: pd.Series) -> pd.Series:
        return pd.Series([r.tobytes() for r in model.binned(np.array(x.tolist(), float))] if len(x) else [], dtype=object)

    kept = ["bins", "__y", *(["__date", "__key", "__ideal"] if extra else [])]
    binned = rows.withColumn("bins", to_bins(F.array(*names)))
    if extra:
        binned = binned.join(F.broadcast(_ideal(rows)), "__date")  # a row per date; rows without a date are in no pair
    state = written(_gradients(binned.select(*kept, F.lit(base).alias("score")), objective, s, first["n"]), "trees-state")
    rng = np.random.default_rng(s.seed)
    for r in range(s.rounds):
        usable = np.zeros(len(names), bool)
        usable[rng.permutation(len(names))[: max(1, round(s.feature_fraction * len(names)))]] = True
        tree = grow(state, len(names), s.bins, usable, s)
        if objective == "l1":
            _medians(state, tree)
        model.trees.append(tree)
        if r + 1 < s.rounds:
            state = written(_gradients(_moved(state, tree, s.rate, kept), objective, s, first["n"]), f"trees-state-{r}")
    return model


def _leaf(tree: Tree, column: str = "bins") -> Column:
    @F.pandas_udf("int")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(tree.leaf_of(np.frombuffer(b"".join(x), np.uint8).reshape(len(x), -1)) if len(x) else [], dtype="int32")

    return run(F.col(column))


def _moved(state: DataFrame, tree: Tree, rate: float, kept: list[str]) -> DataFrame:
    value = F.array(*(F.lit(float(v)) for v in tree.value))
    return state.withColumn("__leaf", _leaf(tree)).select(*kept, (F.col("score") + rate * F.get(value, F.col("__leaf"))).alias("score"))


def _medians(state: DataFrame, tree: Tree) -> None:
    """Leaves of the absolute loss take the median of what is left of their rows."""
    left = state.select(_leaf(tree).alias("leaf"), (F.col("__y") - F.col("score")).alias("left"))
    for r in quantiles(left, "left", [0.5], "leaf").collect():  # a row per leaf
        tree.value[r["leaf"]] = r["q"][0]


def _gradients(state: DataFrame, objective: str, s: Settings, rows: int) -> DataFrame:
    """state (of so many rows) with g and h, as integers."""
    whole = lambda c: F.round(c * UNIT).cast("long")
    if objective == "l1":
        return state.withColumns({"g": whole(F.signum(F.col("score") - F.col("__y"))), "h": whole(F.lit(1.0))})
    if objective == "binary":
        p, w = 1 / (1 + F.exp(-F.col("score"))), F.when(F.col("__y") > 0, s.positive_weight).otherwise(1.0)
        return state.withColumns({"g": whole(w * (p - F.col("__y"))), "h": whole(w * p * (1 - p))})
    if objective != "lambdarank":
        raise ValueError(f"unknown objective {objective}")
    rank = Window.partitionBy("__date").orderBy(F.desc("__by"), "__key")
    ranked = dealt(state, rows, "__date").withColumn("__by", F.round("score", 9)).withColumn("__place", F.row_number().over(rank) - 1)
    ranked = ranked.sortWithinPartitions("__date", F.desc("__by"), "__key").drop("__by")  # as the window left them
    return ranked.mapInArrow(_paired, StructType([*state.schema, StructField("g", LongType()), StructField("h", LongType())]))


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with g and h, from rows of whole dates by place: a date's top rows wait until all its pairs are added up."""
    tops: list[tuple[pa.RecordBatch, np.ndarray]] = []
    top, back = np.zeros((3, 0)), np.zeros((2, 0), np.int64)  # place, score and relevance of the top rows, and what later rows add to them

    def told(rows: pa.RecordBatch, sums: np.ndarray) -> pa.RecordBatch:
        names = [c for c in rows.schema.names if c != "__place"]
        return pa.RecordBatch.from_arrays([*(rows.column(c) for c in names), pa.array(sums[0]), pa.array(sums[1])], [*names, "g", "h"])

    def ended() -> Iterator[pa.RecordBatch]:
        at = 0
        for rows, sums in tops:
            yield told(rows, sums + back[:, at : at + rows.num_rows])
            at += rows.num_rows

    for batch in batches:
        x = np.array([batch.column(c).to_numpy(zero_copy_only=False) for c in ("__place", "score", "__y", "__ideal")], float)
        starts = np.flatnonzero(x[0] == 0)
        for first, last in zip([0, *starts], [*starts, batch.num_rows], strict=True):
            if first == last:
                continue
            if x[0, first] == 0:
                yield from ended()
                tops, top, back = [], np.zeros((3, 0)), np.zeros((2, 0), np.int64)
            own = x[:, first:last]
            n = int((own[0] < TOP).sum())
            top, back = np.hstack([top, own[:3, :n]]), np.hstack([back, np.zeros((2, n), np.int64)])
            sums = np.zeros((2, last - first), np.int64)
            for i in range(0, last - first, STEP):
                g, h = _pairs(own[:, i : i + STEP], top)
                back += np.array([-g.sum(0), h.sum(0)])
                sums[:, i : i + STEP] = g.sum(1), h.sum(1)
            if n:
                tops.append((batch.slice(first, n), sums[:, :n]))
            if first + n < last:
                yield told(batch.slice(first + n, last - first - n), sums[:, n:])
    yield from ended()


def _pairs(own: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What each row's pair with each top row adds to the row's gradient (the top row's gets the opposite) and to both Hessians, in units."""
    place, score, y, ideal = own[:, :, None]
    p_place, p_score, p_y = top[:, None, :]
    higher = np.sign(y - p_y)
    gain = np.abs(np.exp2(y) - np.exp2(p_y))  # 0 for equals, which make no pair
    gain *= np.abs(1 / np.log2(place + 2) - 1 / np.log2(p_place + 2))
    gain *= ideal
    if place[0, 0] < TOP:
        gain *= p_place < place
    with np.errstate(over="ignore"):
        p = 1 / (1 + np.exp(higher * (score - p_score)))
    h = p * (1 - p) * gain
    p *= gain
    return (-higher * _whole(p)).astype(np.int64), _whole(h).astype(np.int64)


def _whole(x: np.ndarray) -> np.ndarray:
    """x, 0 or more, in units; halves go up."""
    return np.floor(x * UNIT + 0.5)


def _discount(place: Column) -> Column:
    return 1 / F.log2(place + 2.0)


def _ideal(rows: DataFrame) -> DataFrame:
    """__date and __ideal: one over the highest discounted gain of a date's TOP rows (0 where there is none)."""
    place = F.row_number().over(Window.partitionBy("__date").orderBy(F.desc("__y")))
    best = rows.select("__date", "__y").withColumn("place", place).where(F.col("place") <= TOP)
    dcg = F.sum((F.pow(2.0, "__y") - 1) * _discount(F.col("place") - 1))
    return best.groupBy("__date").agg(F.when(dcg > 0, 1 / dcg).otherwise(0.0).alias("__ideal"))


def relevance(df: DataFrame, label: str, keys: list[str], tie: str, levels: int = 5) -> DataFrame:
    """df with ``relevance`` 0 to levels - 1: fifths of the label's rank within its group, equal labels by ``tie``; null without a label."""
    group = Window.partitionBy(*keys)
    place = F.row_number().over(group.orderBy(F.col(label).asc_nulls_last(), tie)) / F.count(label).over(group)
    level = F.greatest(F.lit(1), F.least(F.lit(levels), F.ceil(F.round(place * levels, 9)))) - 1
    return df.withColumn("relevance", F.when(F.col(label).isNotNull(), level.cast("int")))


@dataclass
class TwoStage:
    """The probability of being among a group's best times the expected size, held to [0, most]."""

    chance: Boosted
    size: Boosted
    most: float = 0.10

    def columns(self) -> dict[str, Column]:
        return {"probability": 1 / (1 + F.exp(-self.chance.column())), "magnitude": self.size.column()}

    def score(self, df: DataFrame) -> DataFrame:
        out = df.withColumns(self.columns())
        return out.withColumn("score", F.col("probability") * F.greatest(F.lit(0.0), F.least(F.lit(self.most), F.col("magnitude"))))


def fit_two_stage(train: DataFrame, features: Sequence[str], label: str, keys: list[str], tie: str, settings: Settings, top: float = 0.8, training: float = 0.6) -> TwoStage:
    """A classifier of the rows above the ``top`` quantile of their group, and a magnitude fitted to those above the ``training`` quantile."""
    group = Window.partitionBy(*keys)
    rows = train.where(F.col(label).isNotNull())
    place = F.row_number().over(group.orderBy(label, tie)) / F.count("*").over(group)
    rows = written(rows.select(*features, label, F.round(place, 12).alias("__place")), "trees-stages")
    best = rows.withColumn("__best", (F.col("__place") > top).cast("int"))
    return TwoStage(fit(best, features, "__best", "binary", settings), fit(rows.where(F.col("__place") > training), features, label, "l1", settings))
