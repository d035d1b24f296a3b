"""Cross-tokenizer alignment by per-byte label strings.

A text is encoded by two tokenizers over the same bytes (a space and the text). Each byte gets a label
(none, A-end, B-end, both); a regular expression scans the label string and extracts the spans up to each
both-label. A span is a token group: the counts of its labels say how many A and B tokens it holds. A group's last
tokens end together, which is a link; an id pair's count is how many links of the whole corpus hold it.

Texts are encoded once; the groups' digest and the links are written, and counts are added up per batch
before they are shuffled by pair. Then a document's links look their counts up: the most frequent pairs,
HOT at most (the threshold comes from a histogram of the counts), are sent to every task; a document's other pairs
are joined by pair, so nothing that grows with the corpus is broadcast.

Edge cases: a text is left without tokens (zeros, empty digest) if it is null or empty, or if either
tokenizer's bytes differ from a space and the text (one that drops or rewrites characters); special
tokens' strings are plain text; repeated rows count each; null doc_ids are allowed; an empty table gives no rows;
extra columns are ignored. Very long texts are encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, text_or_empty

#: Pairs that are broadcast at most (some 20 bytes each).
HOT = 500_000
#: Bytes of text that are encoded at a time.
AT_ONCE = 1 << 20
#: Labels are the characters 0 (none), 1 (A-end), 2 (B-end) and 3 (both).
NONE = ord("0")
SPAN = re.compile(rb"[^3]*3")
#: How the byte-level tokenizer cuts words, and blanks that go by the plain encoder.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG_BLANK = re.compile(r"\s{256}")


class Sides:
    """Both tokenizers, with the bytes, lengths and decimal forms of their tokens."""

    def __init__(self, a: str, b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a)
        self.a.encode_special_tokens = True
        self.fast = None
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        shown = _shown_bytes()
        vocab = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes_a[i] = bytes(shown[c] for c in token) if all(c in shown for c in token) else token.encode()
        self.bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.len_a, self.len_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        spec = json.loads(self.a.to_str())
        if _by_rank(spec):
            import tiktoken

            special = {t["id"] for t in spec["added_tokens"]}
            ranks = {x: i for i, x in enumerate(self.bytes_a) if i not in special}
            self.fast = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        # A token's decimal id before another of its side, before the other side, and before the next group.
        self.written = [f"{i}{end}" for n, ends in ((len(self.bytes_a), ",|"), (len(self.bytes_b), ",;")) for end in ends for i in range(n)]

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        if self.b.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        return b"" if self.b.is_control(i) else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
        """The ids of both sides of each text, or None where they don't give its bytes."""
        left = map(self.left_ids, texts)
        right = self.b.encode(texts, num_threads=1)
        for text, x, y in zip(texts, left, right, strict=True):
            raw = b" " + text.encode()
            same = bool(text) and b"".join(map(self.bytes_a.__getitem__, x)) == raw and b"".join(map(self.bytes_b.__getitem__, y)) == raw
            yield (np.array(x, np.int64), np.array(y, np.int64)) if same else None

    def left_ids(self, text: str) -> list[int]:
        """The ids of A; the quick encoder gives the same ones, but its pattern can't go through very long blanks."""
        if self.fast is None or LONG_BLANK.search(text):
            return self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids
        return self.fast.encode_ordinary(" " + text)

    def align(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, str]:
        """The A and B tokens up to the end of each group, and the groups as text."""
        ends_a, ends_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        mark = np.zeros(int(ends_a[-1]) + 1, np.uint8)
        mark[ends_a] |= 1
        mark[ends_b] |= 2
        labels = mark[1:] + np.uint8(NONE)
        # Every text ends in a both-label, so the spans cover it.
        stops = np.cumsum(np.fromiter(map(len, SPAN.findall(labels.tobytes())), np.int64))
        upto_a, upto_b = (np.searchsorted(ends, stops, "right") for ends in (ends_a, ends_b))  # labels of a side up to each span's end
        return upto_a, upto_b, self._write(a, b, upto_a, upto_b)

    def _write(self, a: np.ndarray, b: np.ndarray, upto_a: np.ndarray, upto_b: np.ndarray) -> str:
        na, nb = len(self.bytes_a), len(self.bytes_b)
        kind_a, kind_b = a.copy(), b + 2 * na
        kind_a[upto_a - 1] += na  # the last of its side in the group
        kind_b[upto_b - 1] += nb
        size_a, size_b = np.diff(upto_a, prepend=0), np.diff(upto_b, prepend=0)
        out = np.empty(len(a) + len(b), np.int64)
        out[np.arange(len(a)) + np.repeat(upto_b - size_b, size_a)] = kind_a
        out[np.arange(len(b)) + np.repeat(upto_a, size_b)] = kind_b
        return "".join(map(self.written.__getitem__, out.tolist()))[:-1]


def _by_rank(spec: dict) -> bool:
    """Whether a byte-level BPE without a normalizer merges in the order of its ids, as an encoder by ranks does."""
    model, cut = spec["model"], spec["pre_tokenizer"] or {}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ids = [model["vocab"]["".join(m)] for m in pairs]
    plain = spec["normalizer"] is None and cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space") and not model.get("ignore_merges")
    return plain and ids == sorted(ids) and len(model["vocab"]) - len(ids) - 256 <= len(spec["added_tokens"])


@lru_cache(1)
def sides(a: str, b: str) -> Sides:
    return Sides(a, b)


def _shown_bytes() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the rest in order from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


FOUND = "doc_id long, row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary"


def encoded(docs: DataFrame, a: str, b: str) -> DataFrame:
    """A row per document: row (unique), counts, the digest of its groups, and links (pairs a << 32 | b, 64 bits each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, own = TaskContext.get().partitionId() << 33, sides(a, b)
        for batch in batches:
            ids, sizes, lo = batch.column(0), pc.binary_length(batch.column(1)).to_numpy(), 0
            upto = np.cumsum(sizes)
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] - sizes[lo] + AT_ONCE, "right")))
                made = [_row(own, x) for x in own.encode(batch.column(1).slice(lo, hi - lo).to_pylist())]
                columns = [pa.array(x, t) for x, t in zip(zip(*made, strict=True), [pa.int64()] * 4 + [pa.string(), pa.binary()], strict=True)]
                rows = pa.array(np.arange(row, row + hi - lo, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), rows, *columns], [x.split()[0] for x in FOUND.split(", ")])
                row += hi - lo
                lo = hi

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, FOUND)


def _row(own: Sides, ids: tuple[np.ndarray, np.ndarray] | None) -> tuple:
    if ids is None:
        return 0, 0, 0, 0, "", b""
    a, b = ids
    upto_a, upto_b, groups = own.align(a, b)
    links = a[upto_a - 1] << 32 | b[upto_b - 1]
    return len(a), len(b), len(upto_a), len(links), hashlib.sha256(groups.encode()).hexdigest(), links.astype("<i8").tobytes()


def pair_counts(found: DataFrame) -> DataFrame:
    """pair, n (links of the corpus that hold it) and top (no pair of its B id is in more)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i8"))
            if sum(map(len, held)) >= 1 << 21:
                yield _counted(held)
                held = []
        if held:
            yield _counted(held)

    counts = found.select("links").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "alignment-counts").withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)))
    highest = counts.groupBy("b").agg(F.max("n").alias("highest"))  # a row per id of the vocabulary
    return materialize(counts.join(highest, "b").select("pair", "n", (F.col("n") == F.col("highest")).alias("top")), "alignment-pairs")


def _counted(held: list[np.ndarray]) -> pa.RecordBatch:
    pair, n = np.unique(np.concatenate(held), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(pair.astype(np.int64)), pa.array(n.astype(np.int64))], ["pair", "n"])


def hot_from(pairs: DataFrame, most: int) -> int:
    """The least count that at most so many pairs reach: from a histogram of a few hundred classes."""
    exponent = F.floor(F.log2("n"))
    edge = F.floor(F.pow(2.0, exponent) * (1 + F.floor((F.col("n") / F.pow(2.0, exponent) - 1) * 8) / 8)).cast("long")  # the class's least count, or less
    classes = sorted(((r["edge"], r["k"]) for r in pairs.groupBy(edge.alias("edge")).agg(F.count("*").alias("k")).collect()), reverse=True)
    least, taken = None, 0
    for at, k in classes:
        if taken + k > most:
            break
        least, taken = at, taken + k
    return least if least is not None else (classes[0][0] * 2 + 2 if classes else 1)


def align(docs: DataFrame, a: str, b: str, hot: int = HOT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document. a: a byte-level BPE's JSON, b: a sentencepiece model."""
    found = materialize(encoded(docs, a, b), "alignment-found")
    pairs = pair_counts(found)
    least = hot_from(pairs, hot)
    table = pairs.where(F.col("n") >= least).select("pair", "n", "top").toArrow()  # HOT rows at most
    order = np.argsort(pair := table.column("pair").to_numpy())
    known = docs.sparkSession.sparkContext.broadcast((pair[order], table.column("n").to_numpy()[order], table.column("top").to_numpy()[order]))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, count, top = known.value
        for batch in batches:
            sums, best, rare = [], [], []
            for raw in batch.column(1):
                links = np.frombuffer(raw.as_buffer(), "<i8")
                at = np.minimum(np.searchsorted(pair, links), max(len(pair) - 1, 0))
                here = pair[at] == links if len(pair) else np.zeros(len(links), bool)
                sums.append(int(count[at[here]].sum()))
                best.append(int(top[at[here]].sum()))
                rare.append(links[~here])
            ends = np.concatenate([[0], np.cumsum([len(x) for x in rare])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *rare])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums, pa.int64()), pa.array(best, pa.int64()), lists], ["row", "sums", "best", "rare"])

    told = materialize(found.select("row", "links").mapInArrow(look_up, "row long, sums long, best long, rare array<long>"), "alignment-told")
    # Pairs below the threshold: no hot keys among them.
    rare = told.where(F.size("rare") > 0).select("row", F.explode("rare").alias("pair")).groupBy("row", "pair").agg(F.count("*").alias("k"))
    rest = rare.join(pairs.where(F.col("n") < least).hint("merge"), "pair").groupBy("row").agg(F.sum(F.col("k") * F.col("n")).alias("more"), F.sum(F.when(F.col("top"), F.col("k")).otherwise(0)).alias("more_best"))
    zero = F.lit(0).cast("long")
    whole = found.drop("links").join(told.drop("rare").hint("merge"), "row").join(rest.hint("merge"), "row", "left")
    return whole.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("best") + F.coalesce("more_best", zero)).alias("n_best"), (F.col("sums") + F.coalesce("more", zero)).alias("count_sum"), "groups_sha256"
    )
