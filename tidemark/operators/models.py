"""Linear and logistic models by distributed sums, calibration, train-only preprocessing, purged walk-forward folds."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tidemark.functions.expr import rank_pct
from tidemark.operators.evaluate import quantiles


@dataclass(frozen=True)
class Linear:
    """intercept + sum of coef * (x - mean) / scale."""

    features: tuple[str, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    coef: tuple[float, ...]
    intercept: float

    def column(self) -> Column:
        out = F.lit(self.intercept)
        for name, m, s, c in zip(self.features, self.mean, self.scale, self.coef, strict=True):
            out += (F.col(name) - m) / s * c
        return out


def _sums(names: list[str], weight: str | None) -> list[Column]:
    w = F.lit(1.0) if weight is None else F.col(weight)
    k = len(names)
    out = [F.sum(w).alias("n")] + [F.sum(w * F.col(a)).alias(f"s{i}") for i, a in enumerate(names)]
    return out + [F.sum(w * F.col(names[i]) * F.col(names[j])).alias(f"p{i}_{j}") for i in range(k) for j in range(i, k)]


def _solve(r: Row | dict, features: Sequence[str], alpha: float) -> Linear:
    k, n = len(features) + 1, r["n"]
    mean = np.array([r[f"s{i}"] for i in range(k)]) / n
    gram = np.array([[r[f"p{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) - n * np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(gram)[:-1] / n, 0))
    scale[scale < 1e-12] = 1.0
    x = gram[:-1, :-1] / np.outer(scale, scale)
    coef = np.linalg.solve(x + alpha * np.eye(k - 1), gram[:-1, -1] / scale)
    return Linear(tuple(features), tuple(map(float, mean[:-1])), tuple(map(float, scale)), tuple(map(float, coef)), float(mean[-1]))


def ridge(df: DataFrame, features: Sequence[str], label: str, alpha: float, weight: str | None = None) -> Linear:
    """Ridge with standardised features (ddof 0), a free intercept and alpha added to the Gram matrix's diagonal.

    One aggregation gives the sums and cross products of all rows; only a matrix of the features' number
    reaches the driver.
    """
    names = [*features, label]
    r = df.dropna(subset=names).agg(*_sums(names, weight)).first()
    if not r["n"]:
        raise ValueError("no complete rows to fit")
    return _solve(r, features, alpha)


def ridge_by(df: DataFrame, features: Sequence[str], label: str, alpha: float, key: str, weight: str | None = None, date: str | None = None) -> dict[object, tuple[Linear, int, int]]:
    """A ridge per value of a key with few values (folds, sectors), with its rows and dates: one aggregation for all of them."""
    names = [*features, label]
    dates = F.countDistinct(date) if date else F.lit(0)
    rows = df.dropna(subset=names).groupBy(key).agg(*_sums(names, weight), F.count("*").alias("__rows"), dates.alias("__dates")).collect()
    return {r[key]: (_solve(r, features, alpha), r["__rows"], r["__dates"]) for r in rows}


def ridge_arrays(df: DataFrame, x: str, label: str, alpha: float) -> Linear:
    """The same ridge for a column of arrays of one length, features e0, e1, ...: each partition adds up its own Gram matrix by blocks of rows, and these are added on the driver's side of one sum."""
    width = df.agg(F.max(F.size(x))).first()[0]
    k = width + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums, n = np.zeros((k, k)), np.zeros(k), 0
        for batch in batches:
            if batch.num_rows:
                rows = np.column_stack([batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width), batch.column(1).to_numpy(zero_copy_only=False)])
                total, sums, n = total + rows.T @ rows, sums + rows.sum(0), n + len(rows)
        yield pa.RecordBatch.from_pydict({"place": np.arange(k * k + k + 1), "value": np.concatenate([total.ravel(), sums, [float(n)]])})

    rows = df.where(F.col(label).isNotNull() & F.col(x).isNotNull()).select(x, F.col(label).cast("double"))
    parts = rows.mapInArrow(run, "place long, value double").groupBy("place").agg(F.sum("value").alias("value"))
    got = np.array([r["value"] for r in parts.orderBy("place").collect()])  # features squared
    if not len(got) or not got[-1]:
        raise ValueError("no complete rows to fit")
    gram = got[: k * k].reshape(k, k)
    r = {"n": got[-1]} | {f"s{i}": got[k * k + i] for i in range(k)} | {f"p{i}_{j}": gram[i, j] for i in range(k) for j in range(i, k)}
    return _solve(r, [f"e{i}" for i in range(width)], alpha)


def column_by(fitted: dict[object, Linear], key: str) -> Column:
    """The score of each row by its key's model; null without one."""
    out = F.lit(None).cast("double")
    for value, m in fitted.items():
        out = F.when(F.col(key) == F.lit(value), m.column()).otherwise(out)
    return out


def expert_scores(df: DataFrame, train: DataFrame, features: Sequence[str], label: str, alpha: float, key: str, date: str, rows: int, dates: int) -> DataFrame:
    """df with global_model and industry_expert, centred ranks per date (and key) of a ridge for all and one per key, and fallback: whether the key has too few rows or dates and goes by the one for all."""
    whole = ridge(train, features, label, alpha)
    own = {k: m for k, (m, n, d) in ridge_by(train, features, label, alpha, key, date=date).items() if n >= rows and d >= dates}
    out = df.withColumn("__all", F.round(whole.column(), 12)).withColumn("__own", F.round(F.coalesce(column_by(own, key), whole.column()), 12))
    centred = lambda c, keys: F.coalesce(rank_pct(c, keys) - 0.5, F.lit(0.0))
    fallback = ~F.coalesce(F.col(key).isin(*own), F.lit(False)) if own else F.lit(True)
    return out.withColumns({"global_model": centred("__all", [date]), "industry_expert": centred("__own", [date, key]), "fallback": fallback}).drop("__all", "__own")


def single_feature(column: str, direction: int) -> Column:
    return F.col(column) * direction


def logistic(df: DataFrame, features: Sequence[str], label: str, alpha: float, rounds: int = 12, tolerance: float = 1e-9) -> Linear:
    """Logistic ridge by iteratively reweighted least squares: each round is one aggregation of gradient and Hessian."""
    rows = df.dropna(subset=[*features, label])
    stats = rows.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(features)), *(F.stddev_pop(c).alias(f"d{i}") for i, c in enumerate(features))).first()
    mean = [stats[f"m{i}"] or 0.0 for i in range(len(features))]
    scale = [s if (s := stats[f"d{i}"] or 0.0) > 1e-12 else 1.0 for i in range(len(features))]
    k = len(features) + 1
    beta = np.zeros(k)
    penalty = alpha * np.eye(k)
    penalty[0, 0] = 0.0
    z = [F.lit(1.0), *((F.col(c) - m) / s for c, m, s in zip(features, mean, scale, strict=True))]
    for _ in range(rounds):
        eta = sum((z[i] * float(beta[i]) for i in range(1, k)), F.lit(float(beta[0])))
        p = 1 / (1 + F.exp(-eta))
        aggs = [F.sum((F.col(label) - p) * z[i]).alias(f"g{i}") for i in range(k)] + [F.sum(p * (1 - p) * z[i] * z[j]).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)]
        r = rows.agg(*aggs).first()
        gradient = np.array([r[f"g{i}"] or 0.0 for i in range(k)]) - penalty @ beta
        hessian = np.array([[r[f"h{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)]) + penalty
        step = np.linalg.solve(hessian + 1e-12 * np.eye(k), gradient)
        beta += step
        if np.abs(step).max() < tolerance:
            break
    return Linear(tuple(features), tuple(mean), tuple(scale), tuple(map(float, beta[1:])), float(beta[0]))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def platt(df: DataFrame, score: str, label: str) -> tuple[float, float]:
    """a, b of sigmoid(a * score + b); the monotone variant holds a to zero or more."""
    m = logistic(df, [score], label, 1e-6)
    a = m.coef[0] / m.scale[0]
    return a, m.intercept - a * m.mean[0]


def monotone_platt(df: DataFrame, score: str, label: str) -> tuple[float, float]:
    a, b = platt(df, score, label)
    if a >= 0:
        return a, b
    rate = df.dropna(subset=[score, label]).agg(F.avg(label)).first()[0]
    rate = min(max(rate, 1e-9), 1 - 1e-9)
    return 0.0, float(np.log(rate / (1 - rate)))


@dataclass(frozen=True)
class Preprocessor:
    """Clip to training quantiles, fill with the training median, standardise (ddof 0)."""

    stats: tuple[tuple[str, float, float, float, float, float], ...]

    def columns(self) -> dict[str, Column]:
        out = {}
        for name, low, high, median, mean, scale in self.stats:
            filled = F.coalesce(F.when(F.col(name).isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), F.col(name)))), F.lit(median))
            out[name] = (filled - mean) / scale
        return out


def fit_preprocessor(train: DataFrame, features: Sequence[str], low: float = 0.01, high: float = 0.99) -> Preprocessor:
    q = {c: r.q if (r := quantiles(train, c, [low, high, 0.5]).first()) else None for c in features}
    bounds = {c: tuple(q[c]) if q[c] else (0.0, 0.0, 0.0) for c in features}
    filled = [F.coalesce(F.when(F.col(c).isNotNull(), F.greatest(F.lit(bounds[c][0]), F.least(F.lit(bounds[c][1]), F.col(c)))), F.lit(bounds[c][2])) for c in features]
    m = train.agg(*(F.avg(x).alias(f"m{i}") for i, x in enumerate(filled)), *(F.stddev_pop(x).alias(f"d{i}") for i, x in enumerate(filled))).first()
    return Preprocessor(tuple((c, *map(float, bounds[c]), float(m[f"m{i}"] or 0.0), float(m[f"d{i}"] or 0.0) or 1.0) for i, c in enumerate(features)))


def folds(dates: DataFrame, date: str, first_test: int, size: int, embargo: int = 0) -> DataFrame:
    """fold, train_until (exclusive), test_from, test_until (inclusive) over numbered sessions (date, session)."""
    tests = dates.where(F.col("session") > first_test).withColumn("fold", F.floor((F.col("session") - first_test - 1) / size).cast("int"))
    out = tests.groupBy("fold").agg(F.min(date).alias("test_from"), F.max(date).alias("test_until"), (F.min("session") - embargo).alias("s"))
    return out.join(dates.select(F.col("session").alias("s"), F.col(date).alias("train_until")), "s").drop("s")


def assign_folds(panel: DataFrame, spans: DataFrame, date: str, label_end: str) -> DataFrame:
    """panel rows per fold with role train or test; a training row's label ends before the fold's training limit (purged)."""
    train = (F.col(label_end) < F.col("train_until")) & (F.col(date) < F.col("train_until"))
    test = (F.col(date) >= F.col("test_from")) & (F.col(date) <= F.col("test_until"))
    # The fold table has a row per test period: the range join has a side of calendar size.
    return panel.join(F.broadcast(spans), train | test).withColumn("role", F.when(test, "test").otherwise("train"))
