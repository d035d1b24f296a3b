"""Document fingerprints: prefix polynomial hashes.

For code points c_0, c_1, ... the prefix array holds S[i] = sum of c_j B^j for j < i modulo the prime
2^31 - 1, for two bases. The hash of any span is (S[j] - S[i]) B^-i, so span equality takes constant
time, and the longest common extension of two places a binary search. A fingerprint is the 64 smallest
hashes of a text's spans of 32 code points; likeness is the Jaccard estimate of two fingerprints.

Edge cases: a null text counts as empty; the empty text has the empty fingerprint, alike only to
itself; a text shorter than a span is one span; equal texts have equal fingerprints; long texts are
taken block by block.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import partitions, text_or_empty

PRIME = np.uint64(2**31 - 1)
BASES = (911_382_323, 972_663_749)
SPAN = 32
KEPT = 64
BLOCK = 1 << 17
#: Bytes of text of a range of doc_ids, within which neighbours are found side by side, and the most ranges there are.
RANGE_BYTES, RANGES = 8_000_000, 8192
#: Longest table of powers that is kept.
KEPT_POWERS = 2 * BLOCK

_powers: dict[tuple[int, bool], np.ndarray] = {}


def _mod(x: np.ndarray) -> np.ndarray:
    """Remainder of numbers below 2^62 by the prime."""
    x = (x & PRIME) + (x >> np.uint64(31))
    x = (x & PRIME) + (x >> np.uint64(31))
    x[x == PRIME] = 0
    return x


def powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    """Powers 0 to n - 1 of a base or its inverse, kept and doubled as needed."""
    table = _powers.get((base, inverse))
    if table is None:
        table = np.ones(1, np.uint64)
    while len(table) < n:
        step = pow(pow(base, -1, int(PRIME)) if inverse else base, len(table), int(PRIME))
        table = np.concatenate([table, _mod(table * np.uint64(step))])
    if n <= KEPT_POWERS:
        _powers[base, inverse] = table
    return table[:n]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


class PrefixHash:
    """Prefix arrays of one sequence of code points."""

    def __init__(self, points: np.ndarray | str):
        points = code_points(points) if isinstance(points, str) else points
        self.n = len(points)
        self.sums = []
        for base in BASES:
            s = np.zeros(self.n + 1, np.uint64)
            np.cumsum(_mod((points + np.uint64(1)) * powers(base, self.n)), out=s[1:])
            self.sums.append(_mod(s))

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """62-bit hashes of the spans from start to end."""
        out = []
        for base, s in zip(BASES, self.sums, strict=True):
            out.append(_mod(_mod(s[end] + PRIME - s[start]) * powers(base, self.n + 1, True)[start]))
        return out[0] << np.uint64(31) | out[1]

    def windows(self, length: int) -> np.ndarray:
        """Hashes of all spans of one length, by start."""
        count, out = self.n - length + 1, []
        for base, s in zip(BASES, self.sums, strict=True):
            out.append(_mod(_mod(s[length:] + PRIME - s[:count]) * powers(base, count, True)))
        return out[0] << np.uint64(31) | out[1]

    def span(self, start: int, end: int) -> int:
        return int(self.spans(np.array([start]), np.array([end]))[0])

    def equal(self, i: int, j: int, length: int, other: PrefixHash | None = None) -> bool:
        """Whether the span of this length at i is that of the other text (or this one) at j."""
        return self.span(i, i + length) == (other or self).span(j, j + length)

    def extension(self, i: int, j: int, other: PrefixHash | None = None) -> int:
        """Length of the longest common extension of place i here and j there."""
        there = other or self
        low, high = 0, min(self.n - i, there.n - j)
        while low < high:
            middle = (low + high + 1) // 2
            if self.equal(i, j, middle, there):
                low = middle
            else:
                high = middle - 1
        return low


def _smallest(values: np.ndarray) -> np.ndarray:
    """The KEPT smallest distinct values, in order."""
    for most in (4 * KEPT, len(values)):
        part = np.partition(values, most)[:most] if most < len(values) else values
        part = np.unique(part)
        if len(part) >= KEPT or most >= len(values):
            return part[:KEPT]
    return part[:KEPT]


def fingerprint(text: str) -> np.ndarray:
    """Up to KEPT hashes in ascending order."""
    points = code_points(text)
    if len(points) <= SPAN:
        return np.array([PrefixHash(points).span(0, len(points))], np.uint64) if len(points) else np.zeros(0, np.uint64)
    best = np.zeros(0, np.uint64)
    for lo in range(0, len(points) - SPAN + 1, BLOCK):
        best = _smallest(np.concatenate([best, PrefixHash(points[lo : lo + BLOCK + SPAN - 1]).windows(SPAN)]))
    return best


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard estimate: the share of the smallest values of both together that are in both."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.union1d(a, b)[: max(len(a), len(b))] if len(a) == KEPT or len(b) == KEPT else np.union1d(a, b)
    return float(len(np.intersect1d(np.intersect1d(a, b, True), both, True)) / len(both))


def to_hex(values: np.ndarray) -> str:
    return values.astype(">u8").tobytes().hex()


def from_hex(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u8").astype(np.uint64)


def common_start(a: str, b: str) -> int:
    """Longest common extension of the starts of two texts, block by block."""
    total = 0
    for lo in range(0, min(len(a), len(b)), BLOCK):
        found = PrefixHash(a[lo : lo + BLOCK]).extension(0, 0, PrefixHash(b[lo : lo + BLOCK]))
        total += found
        if found < BLOCK:
            break
    return total


def _places(bounds: list[int]) -> tuple[Column, Column]:
    """How many of the bounds lie above the column ``at``, and how many equal it: looked up in two steps of about the root of their number."""
    width = max(1, math.isqrt(len(bounds)))
    groups = [bounds[i : i + width] for i in range(0, len(bounds), width)]  # ascending
    table = F.array(*(F.array(*(F.lit(b).cast("long") for b in g)) for g in groups))
    heads = F.array(*(F.lit(g[0]).cast("long") for g in groups))

    def below(strictly: bool) -> Column:
        """Bounds under ``at``, or up to it."""
        under = (lambda b: F.col("at") > b) if strictly else (lambda b: F.col("at") >= b)
        full = F.size(F.filter(heads, under))
        return F.when(full == 0, 0).otherwise((full - 1) * width + F.size(F.filter(F.element_at(table, F.greatest(full, F.lit(1))), under)))

    upto = below(False)
    return F.lit(len(bounds)) - upto, upto - below(True)


def in_order(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, text (null as empty), range, guest: rows dealt by ranges and sorted by descending doc_id (nulls last; equal ids by a hash of the text) within each.

    Ranges hold about as many bytes each; an id (or null) that has the rows of several ranges is dealt among them by
    the hash. A copy of the first row of every range (the guest) ends the range before it, and that of the very
    first row the last range, so each row but a guest is followed by the next one. Texts are shuffled once.
    """
    lowest = F.lit(-(2**63)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("at", F.coalesce("doc_id", lowest))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = min(RANGES, max(1, -(-size // range_bytes)))
    # As many numbers as there are ranges, RANGES at most.
    bounds = sorted(int(x) for x in rows.approxQuantile("at", [i / ranges for i in range(1, ranges)], 1 / (8 * ranges))) if ranges > 1 else []
    rows = rows.withColumn("tie", F.xxhash64("text"))
    if bounds:
        above, equal = _places(bounds)
        share = (F.col("tie").cast("double") / F.lit(float(2**64)) + 0.5) * (equal + 1)
        rows = rows.withColumn("range", (above + F.least(F.floor(share), equal)).cast("int"))
    else:
        rows = rows.withColumn("range", F.lit(0))
    first = F.max(F.struct("at", F.bitwise_not("tie").alias("tie"))).alias("first")
    heads = {r["range"]: (r["first"]["at"], ~r["first"]["tie"]) for r in rows.groupBy("range").agg(first).collect()}  # a row per range
    order = sorted(heads)
    wanted = docs.sparkSession.createDataFrame([(*heads[r], order[i - 1]) for i, r in enumerate(order)], "at long, tie long, before int")
    guests = rows.join(F.broadcast(wanted), ["at", "tie"]).dropDuplicates(["at", "tie"])
    guests = guests.select("doc_id", "text", "at", "tie", F.col("before").alias("range"), F.lit(True).alias("guest"))
    dealt = rows.withColumn("guest", F.lit(False)).unionByName(guests).repartition(partitions(docs.sparkSession), "range")
    return dealt.sortWithinPartitions("range", "guest", F.desc("at"), "tie").select("doc_id", "text", "range", "guest")


COMPARED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_extension long"


def compare_edited(docs: DataFrame) -> DataFrame:
    """Every document's fingerprint beside that of its edited text (the last third replaced by as much of the next document) and of the next document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # the row that waits for its next one: doc_id, text, fingerprint, range, guest
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part, rows = batch.slice(lo, 512), []
                for doc_id, text, group, guest in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                    own = fingerprint(text)
                    if before is not None and before[3] == group and not before[4]:
                        rows.append(_compared(*before[:3], text, own))
                    before = (doc_id, text, own, group, guest)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)

    return in_order(docs, RANGE_BYTES).mapInArrow(run, COMPARED)


def _compared(doc_id: int | None, text: str, own: np.ndarray, following: str, its: np.ndarray) -> tuple:
    third = len(text) // 3
    edited = text[: len(text) - third] + following[:third]
    changed = fingerprint(edited)
    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, len(text), digest, to_hex(own), to_hex(changed), likeness(own, changed), likeness(own, its), common_start(text, edited)


_NAMES = [x.split()[0] for x in COMPARED.split(", ")]
_TYPES = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[x.split()[1]] for x in COMPARED.split(", ")]
