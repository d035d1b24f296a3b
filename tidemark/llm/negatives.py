"""Hard-negative mining: k-means inverted lists with stored centroid radii.

Centroids are fitted to a bounded sample; every row goes to the list of its nearest centroid, and a list
stores the largest distance of a member. By Cauchy-Schwarz a query's product with any member lies within
its length times that radius of its product with the centroid. A query visits the lists by this upper
bound (held to its window), skips those whose products all lie outside its window, and stops where the
bound falls strictly below its k-th score: ties are still met.

Lists are visited in waves (a query's first list, then up to 8, 64, ...): in a wave the queries of a list meet
its parts as blocks of bounded size, and the k-th scores so far decide who goes on. The same search runs
twice: an anchor's positives are its nearest rows of the same label; each positive's score then sets the
window in which the best rows of other labels are its negatives. Scores are integer products, so results
are exact whatever the sample; it decides speed only.

Lists of any size (a third of all rows in one) are cut into parts by a hash of the row. Broadcast are centroids, radii and
sizes: LISTS rows at most. A row is copied once per block of queries that visit its list.

Edge cases: rows of a null id, label or vector, of null or non-finite components, or longer than 2 ^ 28 after
scaling take no part; vectors of fewer components count as ending in zeros; repeated rows are candidates
each, but never for themselves, and a repeated anchor or positive is answered for each row; an anchor without others of its
label has no rows, nor has a positive of negative score (its window is empty); a score of zero asks for zeros; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, partitions, runs_of
from tidemark.llm.vectors import NONE, best, contenders, integer_vectors, matrix, products

POSITIVES, NEGATIVES, SCALE = 5, 10, 256
#: A negative's score, as percentages of the positive's.
LOW, HIGH = 30, 90
#: Lists at most, rows of the sample for each, and rounds of the fit.
LISTS, PER_LIST, ROUNDS = 512, 32, 10
#: Lists that a query has visited after each wave.
WAVES = (1, 8, 64, LISTS)
#: Rows of one part of a list, and queries that meet it at once.
PART, ASKED, AT_ONCE = 4096, 4096, 512
MOST = 2**62

UNIT = "unit long, anchor long, label long, same int, low long, high long, kth long, norm double, v binary"


def fit(sample: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of the sample: rows drawn apart from each other, then Lloyd's rounds."""
    rows = np.unique(sample, axis=0)
    rng = np.random.default_rng(11)
    centers = rows[rng.permutation(len(rows))[:lists]].astype(float)
    for _ in range(rounds):
        near = nearest(sample, centers)[0]
        count = np.bincount(near, minlength=len(centers))
        sums = np.zeros_like(centers)
        np.add.at(sums, near, sample)
        centers = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centers)
    return centers


def nearest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, and the distance to it."""
    near = ((centers**2).sum(1)[None, :] - 2 * x @ centers.T).argmin(1)
    return near, np.sqrt(((x - centers[near]) ** 2).sum(1))


class Lists:
    """What a task knows of all lists: centroids, radii and sizes."""

    def __init__(self, centers: np.ndarray):
        self.centers, self.radii, self.sizes = centers, np.zeros(len(centers)), np.zeros(len(centers), np.int64)

    def bounds(self, q: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and highest product of each query with the members of each list."""
        middle, reach = q @ self.centers.T, norm[:, None] * self.radii[None, :]
        slack = 0.5 + 1e-11 * norm[:, None] * (np.sqrt((self.centers**2).sum(1)) + self.radii)[None, :]
        return middle - reach - slack, middle + reach + slack


class Index:
    """Rows by list, and the lists."""

    def __init__(self, vectors: DataFrame, lists: int | None = None):
        longest, n = vectors.agg(F.max(F.octet_length("v")), F.count("*")).first()
        self.width = width = (longest or 0) // 4
        lists = min(LISTS, lists or max(1, round(n**0.5)))
        sample = vectors.orderBy(F.xxhash64("row"), "row").limit(lists * PER_LIST).select("v").toArrow().column(0).combine_chunks()
        centers = fit(matrix(sample, width), lists) if n else np.zeros((1, width))

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, PART):
                    b = batch.slice(at, PART)
                    near, distance = nearest(matrix(b.column(3), width), centers)
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32)), pa.array(distance)], ["row", "id", "label", "v", "list", "distance"])

        rows = vectors.select("row", "id", "label", "v").mapInArrow(assign, "row long, id long, label long, v binary, list int, distance double")
        self.rows = materialize(rows, "negatives-lists")
        self.lists = Lists(centers)
        for r in self.rows.groupBy("list").agg(F.max("distance").alias("radius"), F.count("*").alias("n")).collect():  # a row per list
            self.lists.radii[r["list"]], self.lists.sizes[r["list"]] = r["radius"], r["n"]

    def search(self, units: DataFrame, k: int, name: str) -> DataFrame:
        """unit, row, id, score: each unit's k best rows whose label is (same = 1) or isn't its own, within its window. units: the columns of UNIT but kth."""
        spark = units.sparkSession
        found = spark.createDataFrame([], "unit long, row long, id long, score long")
        first = 0
        for last in WAVES:
            kth = found.groupBy("unit").agg(F.min("score").alias("kth"), F.count("*").alias("n")).where(F.col("n") == k).select("unit", "kth")
            asked = units.join(kth, "unit", "left").select("unit", "anchor", "label", "same", "low", "high", F.coalesce("kth", F.lit(int(NONE))).alias("kth"), "norm", "v")
            visits = materialize(self._visits(asked, first, last), f"{name}-visits-{last}")
            count = visits.groupBy("list").count().collect()  # a row per list
            if not count:
                break
            at = F.row_number().over(Window.partitionBy("unit").orderBy(F.desc("score"), "id", "row"))
            both = found.unionByName(self._meet(visits, {r["list"]: r["count"] for r in count}, k))
            found = materialize(both.withColumn("__at", at).where(F.col("__at") <= k).drop("__at"), f"{name}-found-{last}")
            first = last
            if first >= len(self.lists.sizes):
                break
        return found

    def _visits(self, asked: DataFrame, first: int, last: int) -> DataFrame:
        """The units with the lists that they visit next."""
        width, lists = self.width, self.lists

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, AT_ONCE):
                    b = batch.slice(lo, AT_ONCE)
                    low, high, kth = (b.column(i).to_numpy() for i in (4, 5, 6))
                    least, most = lists.bounds(matrix(b.column(8), width), b.column(7).to_numpy())
                    held = np.minimum(most, high[:, None])
                    open_ = (lists.sizes[None, :] > 0) & (most >= low[:, None]) & (least <= high[:, None])
                    # The lists that reach equally far into a window go by how near their middle is to its top.
                    order = np.lexsort((np.abs(most / 2 + least / 2 - high[:, None]), np.where(open_, -held, np.inf)), axis=-1)[:, first:last]
                    go = np.take_along_axis(open_ & (held >= kth[:, None]), order, 1)
                    of, at = np.nonzero(go)
                    yield pa.RecordBatch.from_arrays([*(c.take(pa.array(of)) for c in b.columns), pa.array(order[of, at].astype(np.int32))], [*b.schema.names, "list"])

        return asked.mapInArrow(run, f"{UNIT}, list int")

    def _meet(self, visits: DataFrame, count: dict[int, int], k: int) -> DataFrame:
        """The visiting units and the rows of the lists, block by block."""
        spark, width = visits.sparkSession, self.width
        shape = [(i, -(-int(self.lists.sizes[i]) // PART), -(-n // ASKED)) for i, n in count.items()]
        shape = F.broadcast(spark.createDataFrame(shape, "list int, parts int, blocks int"))  # a row per list
        upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        none = lambda c: F.lit(0).cast("long").alias(c)
        block, part = F.pmod(F.xxhash64("anchor"), F.col("blocks")).cast("int"), F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")
        left = visits.join(shape, "list").withColumn("block", block).withColumn("part", upto("parts"))
        left = left.select("list", "part", "block", F.lit(0).alias("kind"), F.col("unit").alias("row"), F.col("anchor").alias("id"), "label", "same", "low", "high", "kth", "v")
        right = self.rows.join(shape, "list").withColumn("part", part).withColumn("block", upto("blocks"))
        right = right.select("list", "part", "block", F.lit(1).alias("kind"), "row", "id", "label", F.lit(0).alias("same"), none("low"), none("high"), none("kth"), "v")
        both = left.unionByName(right).repartition(partitions(spark), "list", "part", "block").sortWithinPartitions("list", "part", "block", "kind", "id", "row")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for own in runs_of(batches, 3):
                n = int((own.column(3).to_numpy() == 0).sum())
                if not 0 < n < own.num_rows:
                    continue
                q, x = own.slice(0, n), own.slice(n)
                unit, anchor, label, same, low, high, kth = (q.column(i).to_numpy() for i in range(4, 11))
                row, ident, theirs = (x.column(i).to_numpy() for i in (4, 5, 6))
                members = matrix(x.column(11), width)
                for lo in range(0, n, AT_ONCE):
                    own_ = slice(lo, lo + AT_ONCE)
                    one, of = np.unique(anchor[own_], return_index=True, return_inverse=True)[1:]  # an anchor's windows share their products
                    s = products(matrix(q.column(11).take(pa.array(lo + one)), width), members)[of]
                    good = ((label[own_, None] == theirs[None, :]) == (same[own_, None] == 1)) & (anchor[own_, None] != row[None, :])
                    good &= (s >= np.maximum(low[own_], kth[own_])[:, None]) & (s <= high[own_, None])
                    a, b = contenders(np.where(good, s, NONE), k)
                    kept = best(a, s[a, b], ident[b], k)
                    a, b = a[kept], b[kept]
                    yield pa.RecordBatch.from_arrays([pa.array(unit[lo + a]), pa.array(row[b]), pa.array(ident[b]), pa.array(s[a, b])], ["unit", "row", "id", "score"])

        return both.mapInArrow(run, "unit long, row long, id long, score long")


def mine(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE, lists: int | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. rows: id, label, vector; is_anchor reads the id."""
    vectors = materialize(integer_vectors(rows, scale), "negatives-vectors")
    index = Index(vectors, lists)
    anchors = vectors.where(F.coalesce(is_anchor, F.lit(False))).select("row", "id", "label", "norm", "v")
    all_ = [F.lit(1).alias("same"), F.lit(-MOST).alias("low"), F.lit(MOST).alias("high")]
    near = index.search(anchors.select(F.col("row").alias("unit"), F.col("row").alias("anchor"), "label", *all_, "norm", "v"), positives, "positives")
    # A window from low to high percent of the positive's score, in integers.
    pairs = near.select(F.col("unit").alias("row"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), F.monotonically_increasing_id().alias("unit"))
    pairs = materialize(pairs.join(anchors.withColumnRenamed("id", "anchor_id"), "row"), "negatives-pairs")
    window = [F.lit(0).alias("same"), F.ceil(F.expr(f"({low} * positive_score) div 100") + (F.expr(f"({low} * positive_score) % 100") > 0).cast("long")).alias("low"), F.expr(f"({high} * positive_score) div 100").alias("high")]
    units = pairs.where("positive_score >= 0").select("unit", F.col("row").alias("anchor"), "label", *window, "norm", "v")
    found = index.search(units, negatives, "negatives")
    place = F.row_number().over(Window.partitionBy("unit").orderBy(F.desc("score"), "id", "row")).alias("rank")
    return found.select("unit", place, F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(pairs.drop("row", "label", "norm", "v"), "unit").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
