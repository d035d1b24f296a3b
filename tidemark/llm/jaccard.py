"""N-gram Jaccard join: chosen-path join over word shingles.

Every whole text becomes its set of five-word shingle hashes (a shorter text is one shingle) and 64
min-hash tokens of it. Equal sets (told apart by 128 bits) are collapsed to one representative.
Representatives are split recursively on sampled shared tokens: a node samples, in expectation, 1 / threshold
of the token places that its path has not used (one, and by chance a second), and its members go on to a child per
sampled place and value. So pairs at the threshold have one common child in the mean and pairs below it die out:
members of a node that are alike to a degree J below it have J / threshold children in the mean.
Nodes of up to LIMIT members are compared by brute force; larger ones are split further, down to
ln n / ln(1 / threshold) levels, where what is left is compared in blocks. What recursion cannot part, large
groups of near copies, goes by pivots: every member of a large node is compared with one drawn member, in as many
tasks as the node's size asks for. Where many share CLOSE tokens with it, these leave the node, and all that share
LINK tokens are linked to it: whoever is similar to one that left is among them.

Independent runs repeat this until the target recall: a pair at the threshold outlives two levels of a run with a
probability of 0.73, so that eight runs miss fewer than 1 in 10,000. It outlives 8 levels with 0.41 and L with some 6 / L:
sets whose nodes are still large after 5, 9, 17, ... levels
take EXTRA more runs each time. 20,000 sets that are 0.7 alike make some 100 rows each over all runs, fewer if less alike. Tests measure the recall against
brute force.

What meets is linked if the tokens allow for similarity (a bound four standard deviations below the
threshold), which gives coarse components; inside them every pair of sets is then compared exactly, in
blocks, so the links and classes returned are exact for all pairs within a component. Links are counted
where they are found and only a spanning forest of them goes on: nothing emits all pairs of a group.

Edge cases: words are blank-separated and lower-cased; texts without words (null, empty) are equal to
each other and similar to nothing else; repeated rows are copies; null doc_ids are allowed; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, partitions, runs_of, small, text_or_empty
from tidemark.llm.components import components

WORDS = 5
#: The threshold as a fraction.
NUMERATOR, DENOMINATOR = 4, 5
TOKENS = 64
#: Of 64 tokens a pair at 0.8 shares 51 on average, with a deviation of 3.2; fewer than 38 has a chance of some 1 in 50,000.
SHARED = 38
#: In a large node with many near copies of its pivot: tokens shared with it that settle all of a member's own links, and those that link a member to it.
CLOSE = 50
LINK = SHARED + CLOSE - TOKENS
#: Target recall at the threshold, and the share of such pairs that one run finds within two levels.
RECALL, FOUND = 0.9999, 0.72
RUNS = math.ceil(math.log(1 - RECALL) / math.log(1 - FOUND))
#: More runs of sets in nodes that stay large.
EXTRA = 2
#: Members of a node that are compared by brute force, and how many near copies of its pivot are many.
LIMIT, CROWD = 4096, 128
#: Pivots (some 300 bytes each) that may be broadcast.
PIVOTS = 20_000
#: Members, and bytes of sets, of one block of an exact comparison.
BLOCK_SETS, BLOCK_BYTES = 512, 8_000_000
#: Bytes of text hashed at a time.
PIECE_BYTES = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = [_U((k + 1) * _BASE % (1 << 64)) for k in range(2)]
_rng = np.random.default_rng(20)
_XOR = _rng.integers(0, 2**63, TOKENS, dtype=np.uint64)
_MUL = _rng.integers(0, 2**63, TOKENS, dtype=np.uint64) * _U(2) + _U(1)
_powers = {False: np.ones(1, np.uint64), True: np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(n: int, inverse: bool) -> np.ndarray:
    table = _powers[inverse]
    base = pow(_BASE, -1, 1 << 64) if inverse else _BASE
    while len(table) < n:
        table = np.concatenate([table, table * _U(pow(base, len(table), 1 << 64))])
    if n <= 2 * PIECE_BYTES:
        _powers[inverse] = table  # a longer one, for a single huge word, isn't kept
    return table[:n]


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    raw = " ".join(text.lower().split()).encode("utf-8", "surrogatepass")
    parts, at = [np.zeros(0, np.uint64)], 0
    while at < len(raw):
        stop = raw.find(b" ", at + PIECE_BYTES)
        while 0 <= stop < len(raw) and raw.count(b" ", at, stop) < words - 1:
            stop = raw.find(b" ", stop + 1)
        stop = len(raw) if stop < 0 else stop
        parts.append(_shingles(raw[at:stop], words, at == 0))
        if stop == len(raw):
            break
        for _ in range(words - 1):  # the last words begin shingles that end in the next piece
            stop = raw.rfind(b" ", 0, stop)
        at = stop + 1
    return np.unique(np.concatenate(parts))


def _shingles(raw: bytes, words: int, whole: bool) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8)
    stops = np.flatnonzero(b == 32)
    starts, ends = np.concatenate([[0], stops + 1]), np.concatenate([stops, [len(b)]])
    if len(starts) >= words:
        starts, ends = starts[: len(starts) - words + 1], ends[words - 1 :]
    elif whole:
        starts, ends = starts[:1], ends[-1:]
    else:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(mix(b.astype(np.uint64) + _U(1)) * _power(len(b), False), out=sums[1:])
    spans = (sums[ends] - sums[starts]) * _power(len(b) + 1, True)[starts]
    return mix(spans + mix((ends - starts).astype(np.uint64)))


def tokens(found: np.ndarray) -> np.ndarray:
    """TOKENS min-hash values of a set that isn't empty."""
    out = np.full(TOKENS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), 4096):
        out = np.minimum(out, ((found[i : i + 4096, None] ^ _XOR) * _MUL).min(0))
    return (out >> _U(32)).astype(np.uint32)


def set_hash(found: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two longs."""
    raw = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
    return int.from_bytes(raw[:8], "big", signed=True), int.from_bytes(raw[8:], "big", signed=True)


def _map_texts(docs: DataFrame, schema: str, make: Callable[[np.ndarray], tuple], names: list[str], types: list[pa.DataType], mark: Column | None = None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                own = batch.slice(lo, 1024)
                made = [make(shingles(t)) for t in own.column(1).to_pylist()]
                kept = [own.column(i) for i in range(own.num_columns) if i != 1]
                rows = pa.array(np.arange(row, row + len(made), dtype=np.int64))
                row += len(made)
                yield pa.RecordBatch.from_arrays([*kept, rows, *(pa.array(x, k) for x, k in zip(zip(*made, strict=True), types, strict=True))], names)

    marks = [] if mark is None else [mark.alias("mark")]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), *marks).mapInArrow(run, schema)


def signatures(docs: DataFrame, mark: Column | None = None) -> DataFrame:
    """doc_id, mark (a number of the row, 0 unless given), row (unique), h1 and h2 (128 bits of the shingle set), tokens (null where it is empty)."""
    names = ["doc_id", "mark", "row", "h1", "h2", "tokens"]
    make = lambda s: (*set_hash(s), tokens(s).tobytes() if len(s) else None)
    return _map_texts(docs, "doc_id long, mark long, row long, h1 long, h2 long, tokens binary", make, names, [pa.int64(), pa.int64(), pa.binary()], F.lit(0).cast("long") if mark is None else mark)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, TOKENS)


def children(nodes: np.ndarray, used: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, child node and used places (a bit each) of each member's children: of a place that the node samples, and by chance (1 / threshold in all) of a second one."""
    rows, out, marks = [], [], []
    taken = used
    for k in range(2):
        h = mix(nodes + _STEP[k])
        place = h % _U(TOKENS)
        for _ in range(TOKENS):
            again = (taken >> place) & _U(1) == _U(1)
            if not again.any():
                break
            place = np.where(again, (place + _U(1)) % _U(TOKENS), place)
        bit = _U(1) << place
        taken = taken | bit
        own = np.arange(len(nodes)) if k == 0 else np.flatnonzero((h >> _U(40)) % _U(NUMERATOR) < _U(DENOMINATOR - NUMERATOR))
        value = values[own, place[own].astype(np.int64)].astype(np.uint64)
        out.append(mix(mix(nodes[own] ^ (place[own] << _U(48))) + value * _U(_BASE)))
        rows.append(own)
        marks.append(used[own] | bit[own])
    return np.concatenate(rows), np.concatenate(out), np.concatenate(marks)


def first_nodes(sets: DataFrame, first: int, runs: int) -> DataFrame:
    """node, used, set: the root's children of so many runs, from the number ``first`` on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values, ids = _matrix(batch.column(1)), batch.column(0).to_numpy()
            for r in range(first, first + runs):
                row, node, used = children(np.full(len(ids), mix(np.array([r + 1], np.uint64))[0]), np.zeros(len(ids), np.uint64), values)
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(used.view(np.int64)), pa.array(ids[row])], ["node", "used", "set"])

    return sets.select("set", "tokens").mapInArrow(run, "node long, used long, set long")


def pivoted(members: DataFrame) -> DataFrame:
    """node, used, set, tokens, pivot and the number of tokens shared with it, for the members (node, used, set, n, tokens) of large nodes."""
    parts = F.ceil(F.col("n") / LIMIT).cast("int")
    first = F.min(F.struct(F.xxhash64("node", "set").alias("at"), F.col("set").alias("pivot"), F.col("tokens").alias("theirs"))).alias("p")
    pivots = members.groupBy("node", "n").agg(first).select("node", "p.pivot", "p.theirs", parts.alias("parts"))
    # A node's pivot goes to each of its parts, which hold some LIMIT members: as many rows as there are parts.
    pivots = small(materialize(pivots.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts"), "pivots"), PIVOTS)
    dealt = members.withColumn("part", F.pmod(F.xxhash64("set"), parts).cast("int")).join(pivots, ["node", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                same = (_matrix(batch.column(3)) == _matrix(batch.column(5))).sum(1)
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(same.astype(np.int32))], ["node", "used", "set", "tokens", "pivot", "same"])

    return dealt.select("node", "used", "set", "tokens", "pivot", "theirs").mapInArrow(run, "node long, used long, set long, tokens binary, pivot long, same int")


def split(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) of members of large nodes to their node's pivot, and the nodes (node, used, set) two levels below of what is not settled.

    The pivot's own links are settled. Where many are close to it they are settled too: whoever is similar to them is so
    near the pivot that a wider bound links it.
    """
    met = materialize(pivoted(members), "pivoted")
    # As many rows as there are CROWDs of members at most.
    crowds = met.where(F.col("same") >= CLOSE).groupBy("node").agg(F.count("*").alias("k")).where(F.col("k") >= CROWD).select("node", F.lit(True).alias("crowd"))
    told = met.join(small(materialize(crowds, "crowds"), PIVOTS), "node", "left").withColumn("crowd", F.coalesce("crowd", F.lit(False)))
    link = F.col("same") >= F.when(F.col("crowd"), LINK).otherwise(SHARED)
    settled = (F.col("set") == F.col("pivot")) | (F.col("crowd") & (F.col("same") >= CLOSE))
    return told.where(link & (F.col("set") != F.col("pivot"))).select(F.col("set").alias("a"), F.col("pivot").alias("b")), next_nodes(told.where(~settled))


def next_nodes(members: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values, ids = _matrix(batch.column(3)), batch.column(2).to_numpy()
                row, node, used = children(batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy().view(np.uint64), values)
                again, node, used = children(node, used, values[row])
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(used.view(np.int64)), pa.array(ids[row][again])], ["node", "used", "set"])

    return members.select("node", "used", "set", "tokens").mapInArrow(run, "node long, used long, set long")


def _small_links(values: np.ndarray) -> np.ndarray:
    """For each member of a small node the first member that its tokens allow to be similar."""
    n, low = len(values), values.astype(np.uint16)  # half of a token: what meets by chance only links more
    near = np.zeros((n, n), bool)
    for lo in range(0, n, 256):
        same = np.zeros((min(256, n - lo), n), np.uint8)
        for i in range(TOKENS):
            same += low[lo : lo + 256, i, None] == low[None, :, i]
        near[lo : lo + 256] = same >= SHARED
    return _spread(near)


def _spread(near: np.ndarray) -> np.ndarray:
    """Component (its least member) of each member, by a symmetric matrix of links."""
    n = len(near)
    label = np.arange(n)
    if n == 1:
        return label
    while True:
        least = np.minimum(label, np.where(near, label[None, :], n).min(1))
        least = least[least]
        if (least == label).all():
            return label
        label = least


def coarse_links(members: DataFrame) -> DataFrame:
    """a, b: links within nodes of up to LIMIT members. members: node, set, tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = [], []
        for own in runs_of(batches, 1):
            ids, values = own.column(1).to_numpy(), _matrix(own.column(2))
            if len(ids) == 2:
                at = np.array([0, 0 if (values[0] == values[1]).sum() >= SHARED else 1])
            else:
                at = _small_links(values)
            moved = np.flatnonzero(at != np.arange(len(ids)))
            left.append(ids[moved])
            right.append(ids[at[moved]])
            if len(left) >= 2000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"])
                left, right = [], []
        if left:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"])

    dealt = members.select("node", "set", "tokens").repartition(partitions(members.sparkSession), "node").sortWithinPartitions("node", "set")
    return dealt.mapInArrow(run, "a long, b long")


def in_blocks(members: DataFrame) -> DataFrame:
    """Members of nodes of any size as members of nodes of some LIMIT: one for each pair of a node's blocks."""
    blocks = F.ceil(F.col("n") * 2 / LIMIT).cast("int")
    dealt = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select(F.xxhash64("node", F.least("block", "other"), F.greatest("block", "other")).alias("node"), "set")


def coarse_components(sets: DataFrame, runs: int = RUNS) -> DataFrame:
    """set, component of the sets that meet one that may be similar. sets: set (distinct), tokens."""
    levels = min(TOKENS - 4, math.ceil(math.log(max(sets.count(), 2)) / math.log(DENOMINATOR / NUMERATOR)))
    nodes, leaves, links, turn = first_nodes(sets, 0, runs), [], [], 0
    while True:
        nodes = materialize(nodes, "nodes")  # read twice
        # Counts are added up before they are shuffled; a hot node's members are spread by the skew join.
        counts = nodes.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
        met = materialize(nodes.join(counts.hint("merge"), "node"), "paths")
        leaves.append(met.where(F.col("n") <= LIMIT).select("node", "set"))
        if (met.agg(F.max("n")).first()[0] or 0) <= LIMIT:
            break
        deep = F.bit_count("used") >= levels
        leaves.append(in_blocks(met.where((F.col("n") > LIMIT) & deep)))
        large = materialize(met.where((F.col("n") > LIMIT) & ~deep).join(sets, "set"), "large-nodes")
        near, nodes = split(large)
        links.append(near)
        turn += 1
        if turn > 1 and turn & (turn - 1) == 0:
            nodes = nodes.unionByName(first_nodes(large.select("set", "tokens").dropDuplicates(["set"]), runs, EXTRA))
            runs += EXTRA
    links.append(coarse_links(reduce(DataFrame.unionByName, leaves).join(sets, "set")))
    return components(reduce(DataFrame.unionByName, links)).select(F.col("node").alias("set"), F.col("root").alias("component"))


def _overlaps(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sizes of all pairwise intersections of sets given one after another."""
    n, row = len(sizes), np.repeat(np.arange(len(sizes)), sizes)
    if n == 2:
        k = len(np.intersect1d(flat[: sizes[0]], flat[sizes[0] :], assume_unique=True))
        return np.array([[sizes[0], k], [k, sizes[1]]])
    values, place, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1
    use = count[place] > 1
    row, column = row[use], shared[place[use]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((n, n), np.float32)
    width = 2048
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [lo, lo + width])
        x = np.zeros((n, width), np.float32)
        x[row[a:b], column[a:b] - lo] = 1
        out += x @ x.T
    return np.rint(out).astype(np.int64)


def exact_links(members: DataFrame) -> DataFrame:
    """kind 0: a, b of a spanning forest of the links; kind 1: a and its number of linked sets (n) and their documents (m).

    members: component, blocks, block, set, copies, found. A component of several blocks is compared pair by pair of blocks.
    """
    others = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = members.withColumn("other", F.explode(others)).select(
        "component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "set", "copies", "found"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in runs_of(batches, 3):
            i, j = own.column(1)[0].as_py(), own.column(2)[0].as_py()
            block, ids, copies = (own.column(k).to_numpy() for k in (3, 4, 5))
            flat = np.frombuffer(b"".join(own.column(6).to_pylist()), np.uint64)
            sizes = np.array([len(x.as_buffer()) // 8 for x in own.column(6)])
            if len(ids) < 2:
                continue
            both = _overlaps(flat, sizes)
            near = both * (NUMERATOR + DENOMINATOR) >= NUMERATOR * (sizes[:, None] + sizes[None, :])
            if i != j:
                near &= block[:, None] != block[None, :]
            np.fill_diagonal(near, False)
            linked = np.flatnonzero(near.any(1))
            if not len(linked):
                continue
            label = _spread(near)
            n, m = near.sum(1)[linked], (near @ copies)[linked]
            moved = np.flatnonzero(label != np.arange(len(ids)))
            kind = np.concatenate([np.zeros(len(moved), np.int32), np.ones(len(linked), np.int32)])
            zero, none = np.zeros(len(moved), np.int64), np.zeros(len(linked), np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(kind), pa.array(np.concatenate([ids[moved], ids[linked]])), pa.array(np.concatenate([ids[label[moved]], none])), pa.array(np.concatenate([zero, n])), pa.array(np.concatenate([zero, m]))],
                ["kind", "a", "b", "n", "m"],
            )

    return dealt.repartition(partitions(members.sparkSession), "component", "i", "j").sortWithinPartitions("component", "i", "j", "set").mapInArrow(run, "kind int, a long, b long, n long, m long")


def _classes(docs: DataFrame, signed: DataFrame, runs: int) -> DataFrame:
    """h1, h2 (a set), root (the set that names its class), class_id, n_links, n_set_links. signed: the signatures of docs, materialized."""
    lowest = F.lit(-(2**63)).cast("long")
    # A set goes by the least row that has it.
    copies = materialize(signed.groupBy("h1", "h2").agg(F.min("row").alias("set"), F.count("*").alias("copies"), F.min(F.coalesce("doc_id", lowest)).alias("first")), "jaccard-copies")
    chosen = copies.select(F.col("set").alias("row")).hint("merge")  # as many as different texts: never broadcast
    sets = materialize(signed.where("tokens is not null").join(chosen, "row", "left_semi").select(F.col("row").alias("set"), "tokens"), "jaccard-sets")
    coarse = materialize(coarse_components(sets, runs).join(copies, "set"), "jaccard-coarse")
    # The texts of the sets that take part, once each.
    chosen = coarse.select(F.col("first").alias("f")).distinct().hint("merge")  # as many as near duplicates: never broadcast
    texts = docs.select("doc_id", "text").join(chosen, F.coalesce(F.col("doc_id").cast("long"), lowest) == F.col("f"), "left_semi")
    found = _map_texts(texts, "doc_id long, row long, h1 long, h2 long, found binary", lambda s: (*set_hash(s), s.tobytes()), ["doc_id", "row", "h1", "h2", "found"], [pa.int64(), pa.int64(), pa.binary()])
    members = found.select("h1", "h2", "found").join(coarse.select("h1", "h2", "set", "component", "copies"), ["h1", "h2"]).drop("h1", "h2").dropDuplicates(["set"])
    members = materialize(members, "jaccard-members")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK_SETS, F.sum(F.octet_length("found")) / BLOCK_BYTES)).cast("int")
    sizes = members.groupBy("component").agg(blocks.alias("blocks"))
    placed = members.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int"))
    links = materialize(exact_links(placed), "jaccard-links")
    roots = components(links.where("kind = 0").select("a", "b"))
    counts = links.where("kind = 1").groupBy(F.col("a").alias("set")).agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    by_set = copies.join(roots.withColumnRenamed("node", "set"), "set", "left").join(counts, "set", "left").withColumn("root", F.coalesce("root", "set"))
    least = by_set.groupBy("root").agg(F.min("first").alias("least"))
    return by_set.join(least, "root").select(
        "h1",
        "h2",
        "root",
        F.when(F.col("least") != lowest, F.col("least")).alias("class_id"),
        (F.coalesce("m", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("n", F.lit(0)).alias("n_set_links"),
    )


def near_duplicates(docs: DataFrame, runs: int = RUNS) -> DataFrame:
    """One row per document: doc_id, class_id (the least doc_id of its class), n_links (other documents at or above the threshold, copies too) and n_set_links (different sets among them)."""
    signed = materialize(signatures(docs), "jaccard-signatures")
    return signed.select("doc_id", "h1", "h2").join(_classes(docs, signed, runs), ["h1", "h2"]).select("doc_id", "class_id", "n_links", "n_set_links")


def one_per_class(docs: DataFrame, columns: list[str], runs: int = RUNS) -> DataFrame:
    """``columns`` of one row per class of near duplicates: the least doc_id, nulls last, then the least hash of the row.

    Classes are told apart by their sets, rows by doc_id and a hash of all ``columns``, so rows of null or equal doc_ids
    stand for themselves; rows equal in every column are one.
    """
    rows = docs.select(*columns)
    # Null columns don't change a hash, so their places go in as well.
    mark = F.xxhash64(*(x for c in columns for x in (F.col(c), F.col(c).isNull())))
    signed = materialize(signatures(rows, mark), "jaccard-signatures")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    roots = _classes(rows, signed, runs).select("h1", "h2", "root")
    first = signed.select("doc_id", "mark", "h1", "h2").join(roots, ["h1", "h2"]).groupBy("root").agg(F.min(order).alias("first"))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long"))
    kept = first.select(F.coalesce("first.doc_id", F.lit(0).cast("long")).alias("__id"), F.col("first.mark").alias("__mark")).hint("merge")
    return rows.withColumns({"__id": key, "__mark": mark}).join(kept, ["__id", "__mark"], "left_semi").dropDuplicates(["__id", "__mark"]).select(*columns)
