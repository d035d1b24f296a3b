"""Vectors of integers and exact inner products, shared by the searches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: Squared length from which a vector takes no part: below it, 90 times any inner product fits in a long.
TOO_LONG = 2.0**56
NONE = np.int64(-(2**62))
SCHEMA = "row long, id long, label long, norm double, v binary"


def integer_vectors(rows: DataFrame, scale: int) -> DataFrame:
    """row (unique), id, label, norm and v (32-bit integers floor(scale * x)) of the rows (id, label, vector) whose vectors are there and finite in every component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            lists, n = batch.column(2), batch.num_rows
            if not n:
                continue
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            of = np.repeat(np.arange(n), sizes)
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))  # a null component is NaN
                bad = ~np.isfinite(x)
                norm = np.bincount(of, np.where(bad, 0.0, x) ** 2, n)
            good = lists.is_valid().to_numpy(zero_copy_only=False) & (np.bincount(of, bad, n) == 0) & (norm < TOO_LONG)
            data = x[good[of]].astype("<i4").tobytes()
            ends = np.concatenate([[0], np.cumsum(4 * sizes[good])]).astype(np.int32)
            v = pa.Array.from_buffers(pa.binary(), int(good.sum()), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data)])
            kept = pa.array(good)
            yield pa.RecordBatch.from_arrays([pa.array(row + np.flatnonzero(good)), batch.column(0).filter(kept), batch.column(1).filter(kept), pa.array(np.sqrt(norm[good])), v], ["row", "id", "label", "norm", "v"])
            row += n

    columns = [rows["id"].cast("long").alias("id"), rows["label"].cast("long").alias("label"), rows["vector"].cast("array<double>").alias("vector")]
    return rows.select(*columns).where("id is not null and label is not null").mapInArrow(run, SCHEMA)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors as rows of doubles; shorter ones end in zeros."""
    sizes = pc.binary_length(column).to_numpy() // 4
    flat = np.frombuffer(b"".join(column.to_pylist()), "<i4").astype(np.float64)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products, exact: in doubles where no sum can pass their 53 bits, else in integers."""
    if np.sqrt((a**2).sum(1).max() * (b**2).sum(1).max()) < 2**52:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.T.astype(np.int64)


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The inner product of each row of a with that of b, exact."""
    return np.einsum("ij,ij->i", a.astype(np.int64), b.astype(np.int64))


def contenders(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Where a row's k best scores can be (ties of the last included); NONE is no score."""
    least = np.partition(scores, -k, axis=1)[:, -k, None] if scores.shape[1] > k else NONE
    return np.nonzero((scores >= least) & (scores > NONE))


def best(unit: np.ndarray, score: np.ndarray, ident: np.ndarray, k: int) -> np.ndarray:
    """Places of each unit's k highest scores, ties to the smaller id."""
    order = np.lexsort((ident, -score, unit))
    if not len(order):
        return order
    own = unit[order]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    place = np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own))))
    return order[place < k]
