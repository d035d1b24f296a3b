"""Sharding: minimax contiguous partition.

Documents with equal texts form an atomic group; groups are ordered by the hash of their text. The
smallest shard capacity that a greedy cut of this order into the given number of shards respects is
found by binary search, and the order is cut there. A group larger than an even share would force its
size on all shards, so such groups are peeled off first, one shard each.

The order is never gathered. The driver sees sums over ranges of the hash ("atoms", a few thousand),
brackets the capacity by treating an atom of several groups as indivisible (upper bound) and as fluid
(lower bound), and asks for finer atoms only around the possible cuts until both bounds meet; the
result is exactly that of the search over single groups.

Edge cases: a null text has size 8 and counts as a text of its own; equal or null doc_ids are separate
rows; an empty table gives no rows; extra columns are ignored; there may be fewer groups than shards.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass, replace
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialize

SHARDS = 24
ROW_BYTES = 8
FIRST_BITS, MORE_BITS = 12, 8
#: Groups of refined atoms come one by one when there are no more than so many.
SINGLES = 20_000
#: Rows of a shard are numbered side by side in so many ranges at least, and so many that a shard with all rows had about CELL_ROWS in each.
CELLS, CELL_ROWS = 64, 1_000_000


@dataclass(frozen=True)
class Atom:
    lo: int
    hi: int
    size: int
    groups: int
    bits: int


def _range(key: Column, bits: int) -> Column:
    return F.shiftright(key, 64 - bits) if bits < 64 else key


def atoms_of(groups: DataFrame, bits: int) -> list[Atom]:
    rows = groups.groupBy(_range(F.col("key"), bits)).agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.sum("size").alias("size"), F.count("*").alias("groups")).collect()
    return [Atom(r["lo"], r["hi"], r["size"], r["groups"], bits) for r in rows]


class Order:
    """Atoms in order; where greedy cuts of a given capacity fall if atoms of several groups are indivisible or fluid."""

    def __init__(self, atoms: list[Atom]):
        self.atoms = sorted(atoms, key=lambda a: a.lo)
        self.ends = list(accumulate((a.size for a in self.atoms)))
        self.total = self.ends[-1]

    def cuts(self, capacity: int, fluid: bool, shards: int) -> tuple[list[int], bool]:
        """Positions (bytes before the cut) after each shard; whether all fits."""
        at, out = 0, []
        for _ in range(shards):
            j = bisect_right(self.ends, at + capacity)
            if j == len(self.ends):
                return [*out, self.total], True
            end = self.ends[j - 1] if j else 0
            if fluid and self.atoms[j].groups > 1:
                end = at + capacity
            out.append(max(at, end))
            at = out[-1]
        return out, False

    def smallest(self, fluid: bool, shards: int, least: int, most: int) -> int:
        while least < most:
            middle = (least + most) // 2
            if self.cuts(middle, fluid, shards)[1]:
                most = middle
            else:
                least = middle + 1
        return least


def minimax_cuts(groups: DataFrame, shards: int, largest: int) -> tuple[int, list[int]]:
    """The smallest capacity, and the last key of each shard but the final one. groups: key (distinct), size."""
    atoms = atoms_of(groups, FIRST_BITS)
    if not atoms:
        return 0, []
    while True:
        order = Order(atoms)
        low = order.smallest(True, shards, max(largest, -(-order.total // shards)), order.total)
        high = order.smallest(False, shards, low, order.total)
        if low == high:
            ends = order.cuts(high, False, shards)[0][:-1]
            return high, [order.atoms[bisect_right(order.ends, e) - 1].hi for e in ends if e]
        wanted: set[int] = set()
        # Cuts move on as the capacity grows, so the k-th lies between these two positions.
        for a, b in zip(order.cuts(low, False, shards)[0], order.cuts(high, True, shards)[0], strict=False):
            first, last = bisect_right(order.ends, a), bisect_right(order.ends, b)
            wanted.update(range(first, min(last + 1, len(atoms))))
        chosen = [i for i in wanted if order.atoms[i].groups > 1]
        picked = [order.atoms[i] for i in chosen]
        here = F.lit(False)
        for bits in {a.bits for a in picked}:
            here |= _range(F.col("key"), bits).isin([a.lo >> (64 - bits) for a in picked if a.bits == bits])
        few = sum(a.groups for a in picked) <= SINGLES
        deeper = max(a.bits for a in picked)
        fresh = atoms_of(groups.where(here), 64 if few else min(64, deeper + MORE_BITS))
        kept = [a for i, a in enumerate(order.atoms) if i not in set(chosen)]
        atoms = kept + [replace(a, bits=64 if few else min(64, deeper + MORE_BITS)) for a in fresh]


def sized_rows(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.xxhash64(F.lit(1), text), F.lit(0)).alias("key"),
    )


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null: sizes decide) and the capacity found."""
    if shards < 1:
        raise ValueError("shards must be positive")
    rows = materialize(sized_rows(docs), "sharding-rows")
    groups = materialize(rows.groupBy("key").agg(F.sum("size").alias("size")), "sharding-groups")
    total = groups.agg(F.sum("size")).first()[0] or 0
    peeled: list[int] = []
    top = groups.orderBy(F.desc("size"), "key").limit(shards).collect()
    left = shards
    while left > 1 and len(peeled) < len(top) and top[len(peeled)]["size"] * left > total:
        total -= top[len(peeled)]["size"]
        peeled.append(top[len(peeled)]["key"])
        left -= 1
    rest = groups.where(~F.col("key").isin(peeled)) if peeled else groups
    largest = top[len(peeled)]["size"] if len(peeled) < len(top) else 0
    capacity, cuts = minimax_cuts(rest, left, largest)
    number = F.lit(len(peeled))
    for key in cuts:
        number += (F.col("key") > key).cast("int")
    for i, key in enumerate(peeled):
        number = F.when(F.col("key") == key, i).otherwise(number)
    cells = max(CELLS, rows.count() // CELL_ROWS)
    placed = rows.withColumns({"shard": number.cast("int"), "cell": F.pmod(F.xxhash64("doc_id", "key"), F.lit(cells))})
    # A count per shard and cell: numbered per shard, then added to the numbers within a cell.
    counts = placed.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("shard", "cell").orderBy("key", "doc_id", "size")
    return (
        placed.withColumn("local", F.row_number().over(own) - 1)
        .join(F.broadcast(bases), ["shard", "cell"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("local")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.lit(capacity).cast("long").alias("capacity"))
    )
