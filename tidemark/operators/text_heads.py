"""Linear heads on hashed text features with the Huber loss, for several targets at once.

Each head has features of its own (hashed n-grams, L2-normalised) and each target weights of its own in every head. A
round is one pass over the rows: every task adds up the gradients of all heads and targets for its rows, as integers of
2 ^ -32, so that sums don't depend on their order; heads x targets x buckets of them reach the driver. Targets are clipped
and standardised by the training rows alone.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.stages import written

UNIT = float(1 << 32)


@dataclass(frozen=True)
class Heads:
    """weights: heads x targets x (buckets + 1), the last one the intercept."""

    names: tuple[str, ...]
    targets: tuple[str, ...]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def column(self, head: str, blend: Sequence[float]) -> Column:
        """The blend of a head's standardised targets for a row of ``features``; null where it has none."""
        w = np.asarray(blend) @ self.weights[self.names.index(head)]

        @F.pandas_udf("double")
        def run(x: pd.DataFrame) -> pd.Series:
            return pd.Series([None if i is None else float(w[-1] + w[i] @ v) for i, v in zip(x["at"], x["weight"], strict=True)], dtype=float)

        return run(F.struct(F.col(f"{head}_at").alias("at"), F.col(f"{head}_weight").alias("weight")))


def char_grams(text: str, sizes: Sequence[int]) -> np.ndarray:
    """A 64-bit hash of each run of so many characters."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    out = [np.zeros(0, np.uint64)]
    for n in sizes:
        h = np.full(max(0, len(codes) - n + 1), n, np.uint64)
        for j in range(n):
            h = (h ^ codes[j : j + len(h)]) * _MIX
            h ^= h >> np.uint64(29)
        out.append(h)
    return np.concatenate(out)


def word_grams(text: str, sizes: Sequence[int]) -> np.ndarray:
    """A 64-bit hash of each run of so many words between blanks."""
    words = text.split()
    runs = Counter(" ".join(words[i : i + n]) for n in sizes for i in range(len(words) - n + 1))
    hashes = np.array([int.from_bytes(blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big") for w in runs], np.uint64)
    return np.repeat(hashes, np.fromiter(runs.values(), np.int64, len(runs)))


#: Rows to an Arrow batch: features of a text take some 100 KB, so that ten thousand of them would be a GB in every worker.
BATCH = 256


def session(spark: SparkSession) -> SparkSession:
    """A session for features, fits and scores: what a worker holds stays the same when tables grow."""
    own = spark.newSession()
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)
    for c in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(c, spark.conf.get(c))
    return own


GRAMS = {"char": char_grams, "word": word_grams}
_MIX = np.uint64(0x9E3779B97F4A7C15)


def features(df: DataFrame, key: str, text: str, heads: dict[str, tuple[str, Sequence[int]]], buckets: int) -> DataFrame:
    """key and, for each head, ``<head>_at`` and ``<head>_weight``: the buckets of its n-grams and their L2-normalised counts.

    heads: by name the kind of n-grams (char or word) and their sizes. One pass without a shuffle, in time linear in the
    texts; a text without n-grams (null, empty) has empty features.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            columns = []
            for kind, sizes in heads.values():
                counts = [np.unique(GRAMS[kind](t, sizes) % np.uint64(buckets), return_counts=True) for t in texts]
                columns += [pa.array([at.astype(np.int32) for at, _ in counts], pa.list_(pa.int32())), pa.array([n / np.sqrt(float((n**2).sum())) if len(n) else n.astype(float) for _, n in counts], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [key, *(f"{h}_{c}" for h in heads for c in ("at", "weight"))])

    kind = df.schema[key].dataType.simpleString()
    schema = ", ".join([f"`{key}` {kind}", *(f"{h}_at array<int>, {h}_weight array<double>" for h in heads)])
    return df.select(key, F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)


def fit(train: DataFrame, heads: Sequence[str], targets: Sequence[str], buckets: int, clip: float = 0.2, epsilon: float = 0.1, alpha: float = 1e-4, rate: float = 0.5, rounds: int = 20) -> Heads:
    """Gradient descent on the mean Huber loss of the standardised targets. train: the columns of ``features`` and the targets; rows without all targets take no part; none at all raise an error."""
    held = lambda t: F.greatest(F.lit(-clip), F.least(F.lit(clip), F.col(t).cast("double"))).alias(t)
    rows = written(train.dropna(subset=list(targets)).select(*(f"{h}_{c}" for h in heads for c in ("at", "weight")), *map(held, targets)), "heads-rows")
    m = rows.agg(F.count("*").alias("n"), *(F.avg(t).alias(f"m{i}") for i, t in enumerate(targets)), *(F.stddev_samp(t).alias(f"s{i}") for i, t in enumerate(targets))).first()
    n = m["n"]
    if not n:
        raise ValueError("no rows to fit")
    mean = np.array([m[f"m{i}"] for i in range(len(targets))])
    scale = np.array([s if (s := m[f"s{i}"]) is not None and s > 1e-8 else 1.0 for i in range(len(targets))])
    weights = np.zeros((len(heads), len(targets), buckets + 1))
    for _ in range(rounds):
        weights = weights - rate * (_gradient(rows, weights, mean, scale, len(heads), epsilon) / n + alpha * np.where(np.arange(buckets + 1) < buckets, weights, 0.0))
    return Heads(tuple(heads), tuple(targets), mean, scale, weights)


def _gradient(rows: DataFrame, weights: np.ndarray, mean: np.ndarray, scale: np.ndarray, heads: int, epsilon: float) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(weights.shape, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            y = (np.column_stack([batch.column(2 * heads + t).to_numpy() for t in range(len(mean))]) - mean) / scale
            for h in range(heads):
                at, v = (batch.column(2 * h + i).flatten().to_numpy() for i in range(2))
                of = np.repeat(np.arange(batch.num_rows), batch.column(2 * h).value_lengths().to_numpy())
                for t in range(len(mean)):
                    w = weights[h, t]
                    left = w[-1] + np.bincount(of, w[at] * v, batch.num_rows) - y[:, t]
                    pull = np.clip(left, -epsilon, epsilon)
                    np.add.at(total[h, t], at, np.rint(pull[of] * v * UNIT).astype(np.int64))
                    total[h, t, -1] += np.rint(pull * UNIT).astype(np.int64).sum()
        flat = total.ravel()
        used = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(flat[used])], ["at", "g"])

    sums = rows.mapInArrow(run, "at long, g long").groupBy("at").agg(F.sum("g").alias("g")).toArrow()  # heads x targets x buckets at most
    out = np.zeros(weights.size)
    out[sums.column("at").to_numpy()] = sums.column("g").to_numpy() / UNIT
    return out.reshape(weights.shape)
