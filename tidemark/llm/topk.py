"""Exact top-k search: norm-sorted inner products with SVD-rotated partial sums.

All vectors are ranked by descending length and cut into blocks of consecutive ones. Queries meet the
blocks in waves, the longest vectors first (1 block, then up to 16, 256, ... in all). After a wave a query
whose k-th score is s and whose length is l needs only vectors no shorter than s / l (Cauchy-Schwarz);
queries are ordered by that length and cut into blocks too, so that a block of vectors goes only to the
query blocks that may still need some of it, and a query only to blocks that reach its length.

Where a block of queries meets one of vectors, chunks of vectors are taken by descending length until no
query can gain. Both sides are rotated by the right singular vectors of a sample, which puts most of a
product into its first terms: partial sums grow stage by stage, and a pair is left as soon as its sum so far plus the
product of both residual lengths is below the query's k-th score. Scores of what is left are integer
products of the vectors themselves, so the rotation (of a sample of SAMPLE rows) decides speed only.

No vector is held back, and a wave is a join of blocks of bounded size: the number of blocks grows with the rows, a
block's memory doesn't. The driver sees a length per block. A row goes to as many tasks as query blocks need it.

Edge cases: rows of a null id or vector, of null or non-finite components, or longer than integers can hold
exactly (2 ^ 28 after scaling) take no part; vectors of fewer components count as ending in zeros; repeated rows
are candidates each, and a repeated query is answered for each row; zero vectors have score 0 with everything; fewer candidates
than k are all returned; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, partitions, runs_of
from tidemark.llm.vectors import NONE, best, contenders, integer_vectors, matrix, paired, products

K, SCALE = 10, 1024
#: Rows that the rotation is fitted to.
SAMPLE = 16_384
#: Bytes of one block of vectors or queries, and its least number of rows.
BLOCK_BYTES, LEAST_ROWS = 2 << 20, 512
#: Blocks that have been visited after each wave: a power of this number.
WAVE = 16
CHUNK = 512
#: Parts of the components after which partial sums are looked at, and the share of pairs from which they are followed one by one.
STAGES, FEW = (1 / 8, 1 / 4, 1 / 2), 1 / 16


def ranked(df: DataFrame, order: list[Column], name: str) -> tuple[DataFrame, int]:
    """df with ``rank`` (from 0, by order) and its rows: sorted in ranges, whose counts are added up."""
    ranges = df.repartitionByRange(partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    placed = materialize(ranges.withColumn("__at", F.monotonically_increasing_id()), name)
    counts = sorted(placed.groupBy(F.shiftright("__at", 33).alias("part")).count().collect())  # a row per partition
    first, rows = [], 0
    for part, n in counts:
        first.append((part, rows))
        rows += n
    offsets = F.broadcast(df.sparkSession.createDataFrame(first, "__part long, __first long"))
    out = placed.withColumn("__part", F.shiftright("__at", 33)).join(offsets, "__part")
    return out.withColumn("rank", F.col("__first") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__at", "__part", "__first"), rows


def rotation(vectors: DataFrame, width: int) -> np.ndarray:
    sample = vectors.orderBy(F.xxhash64("row"), "row").limit(SAMPLE).select("v").toArrow().column(0).combine_chunks()
    return np.linalg.svd(matrix(sample, width), full_matrices=True)[2].T if 0 < len(sample) < width else np.linalg.eigh(_gram(matrix(sample, width)))[1][:, ::-1]


def _gram(x: np.ndarray) -> np.ndarray:
    return x.T @ x


def visit(q: np.ndarray, x: np.ndarray, kth: np.ndarray, own_q: np.ndarray, own_x: np.ndarray, ids: np.ndarray, turn: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query place, id and score of each query's k best among the rows of x, which come by descending length; none below its kth score so far."""
    qr, xr, kth = q @ turn, x @ turn, kth.copy()
    qn, xn = np.sqrt((q**2).sum(1)), np.sqrt((x**2).sum(1))
    width = q.shape[1]
    stops = sorted({max(1, round(width * s)) for s in STAGES} | {width}) if width else []
    rest = lambda m, stop: np.sqrt((m[:, stop:] ** 2).sum(1))
    bounds = [(rest(qr, s), rest(xr, s)) for s in stops]
    unit = score = ident = np.zeros(0, np.int64)
    for lo in range(0, len(x), CHUNK):
        hi = min(lo + CHUNK, len(x))
        slack = 0.5 + 1e-11 * qn * xn[lo]  # scores are integers
        act = np.flatnonzero(qn * xn[lo] + slack >= kth)
        if not len(act):
            break  # the vectors to come are no longer
        least = (kth[act] - slack[act])[:, None]
        near, part, start = np.ones((len(act), hi - lo), bool), 0.0, 0
        for stop, (rq, rx) in zip(stops, bounds, strict=True):
            if stop == width:
                break  # what is left is scored as a whole
            part = part + qr[act, start:stop] @ xr[lo:hi, start:stop].T
            start = stop
            near = part + rq[act, None] * rx[None, lo:hi] >= least
            if near.mean() < FEW:
                break
        near &= own_q[act, None] != own_x[None, lo:hi]
        if near.mean() < FEW:
            a, b = np.nonzero(near)
            found = paired(q[act[a]], x[lo + b])
        else:
            scores = np.where(near, products(q[act], x[lo:hi]), NONE)
            a, b = contenders(scores, k)
            found = scores[a, b]
        good = found >= kth[act[a]]
        unit = np.concatenate([unit, act[a[good]]])
        score, ident = np.concatenate([score, found[good]]), np.concatenate([ident, ids[lo + b[good]]])
        kept = best(unit, score, ident, k)
        unit, score, ident = unit[kept], score[kept], ident[kept]
        full = np.flatnonzero(np.bincount(unit, minlength=len(q)) == k)
        lowest = np.full(len(q), np.iinfo(np.int64).max)
        np.minimum.at(lowest, unit, score)
        kth[full] = np.maximum(kth[full], lowest[full])
    return unit, ident, score


def top_k(rows: DataFrame, is_query: Column, k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query with the other rows. rows: id, vector and what is_query reads."""
    asked = F.coalesce(is_query, F.lit(False)).cast("long")
    vectors = materialize(integer_vectors(rows.select("id", asked.alias("label"), "vector"), scale), "topk-vectors")
    spark = vectors.sparkSession
    longest, n = vectors.agg(F.max(F.octet_length("v")), F.count("*")).first()
    width = (longest or 0) // 4
    most = max(LEAST_ROWS, BLOCK_BYTES // (4 * max(width, 1)))
    size = min(most, max(LEAST_ROWS, -(-n // (2 * partitions(spark)))))
    turn = rotation(vectors, width) if n and width else np.zeros((width, width))
    sorted_, _ = ranked(vectors, [F.desc("norm"), F.col("row")], "topk-sorted")
    blocks = sorted_.withColumn("block", F.floor(F.col("rank") / size))
    lengths = np.array([r[1] for r in sorted(blocks.groupBy("block").agg(F.max("norm")).collect())])  # a number per block
    queries = vectors.where("label = 1").select("row", "id", "norm", "v")
    found = spark.createDataFrame([], "query long, id long, score long")
    low = 0
    while low < len(lengths):
        high = min(len(lengths), max(1, low * WAVE))
        found = materialize(_best(found.unionByName(_wave(queries, found, blocks.where(F.col("block").between(low, high - 1)), low, lengths[low:high], size, turn, width, k)), k), f"topk-found-{low}")
        low = high
    place = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(place)).join(queries.select(F.col("row").alias("query"), F.col("id").alias("query_id")), "query").select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def _best(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return found.withColumn("__place", place).where(F.col("__place") <= k).drop("__place")


def _wave(queries: DataFrame, found: DataFrame, rows: DataFrame, low: int, lengths: np.ndarray, size: int, turn: np.ndarray, width: int, k: int) -> DataFrame:
    """What the queries find in blocks ``low`` and on, no worse than what they have."""
    kth = found.groupBy("query").agg(F.min("score").alias("kth"), F.count("*").alias("n")).where(F.col("n") == k).select(F.col("query").alias("row"), "kth")
    asked = queries.join(kth, "row", "left").withColumn("kth", F.coalesce("kth", F.lit(int(NONE))))
    # Only vectors of this length can have a score as high; a k-th score of 0 or less asks for all.
    reach = F.when((F.col("kth") > 0) & (F.col("norm") > 0), (F.col("kth") - 0.5) / F.col("norm") * (1 - 1e-11)).otherwise(-1.0)
    asked, _ = ranked(asked.withColumn("reach", reach).where(F.col("reach") <= float(lengths[0])), [F.col("reach"), F.col("row")], f"topk-queries-{low}")
    asked = asked.withColumn("part", F.floor(F.col("rank") / size))
    least = np.array([r[1] for r in sorted(asked.groupBy("part").agg(F.min("reach")).collect())])  # a number per block of queries
    names = ["block", "part", "kind", "place", "row", "id", "kth", "v"]

    def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                count = np.searchsorted(-lengths, -b.column(0).to_numpy(), "right")
                yield _copies(b, count, low, "block")

    def to_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                count = np.searchsorted(least, b.column(0).to_numpy(), "right")
                yield _copies(b, count, 0, "part")

    def _copies(b: pa.RecordBatch, count: np.ndarray, first: int, key: str) -> pa.RecordBatch:
        of = np.repeat(np.arange(len(count)), count)
        made = pa.array(first + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count))
        taken = b.take(pa.array(of))
        return pa.RecordBatch.from_arrays([made if n == key else taken.column(taken.schema.get_field_index(n)) for n in names], names)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in runs_of(batches, 2):
            n = int((own.column(2).to_numpy() == 0).sum())
            if 0 < n < own.num_rows:
                q, x = own.slice(0, n), own.slice(n)
                unit, ident, score = visit(matrix(q.column(7), width), matrix(x.column(7), width), q.column(6).to_numpy(), q.column(4).to_numpy(), x.column(4).to_numpy(), x.column(5).to_numpy(), turn, k)
                yield pa.RecordBatch.from_arrays([pa.array(q.column(4).to_numpy()[unit]), pa.array(ident), pa.array(score)], ["query", "id", "score"])

    schema = "block long, part long, kind int, place long, row long, id long, kth long, v binary"
    none = F.lit(0).cast("long")
    left = asked.select("reach", none.alias("block"), "part", F.lit(0).alias("kind"), F.col("rank").alias("place"), "row", "id", "kth", "v").mapInArrow(to_blocks, schema)
    right = rows.select("norm", "block", none.alias("part"), F.lit(1).alias("kind"), F.col("rank").alias("place"), "row", "id", none.alias("kth"), "v").mapInArrow(to_queries, schema)
    both = left.unionByName(right).repartition(partitions(queries.sparkSession), "block", "part").sortWithinPartitions("block", "part", "kind", "place")
    return both.mapInArrow(search, "query long, id long, score long")
