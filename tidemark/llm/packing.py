"""Packing: concatenate and cut.

Pass one tokenises every document once and stores its ids together with the partition it was read
in and the tokens before it in that partition. The partition totals (one row per partition) are
prefix-summed; partition base + local start is the document's global offset in the concatenated
stream. Pass two cuts the stream every ``window`` ids and emits a boundary record per piece. The ids
are never shuffled.

Edge cases: a null or empty text is the end id alone; equal or null doc_ids are separate documents;
an empty table gives no pieces; extra columns are ignored. Only the last sequence can be short.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, text_or_empty

WINDOW = 4096
END_ID = 2
#: Bytes of words and ids that a Python worker remembers; beyond them the older part is forgotten, results stay the same.
MEMORY_BYTES = 64_000_000
#: Bytes of text encoded at a time; longer texts are taken in pieces that end at white space.
PIECE_BYTES = 1 << 20

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

_encoders: dict[str, WordEncoder] = {}
_GAPS = re.compile(rb"[ \t\n\r]")


_U = np.uint64
_GAP = np.isin(np.arange(256), list(b" \t\n\r"))
_LETTER = np.array([chr(i).isascii() and chr(i).isalpha() for i in range(256)])
_LOWER = np.array([i + 32 if 65 <= i <= 90 else i for i in range(256)], np.uint8)
#: Bytes that keep a word as it is written: those beyond ASCII, and '<', which may begin a special token.
_AS_IS = (np.arange(256) >= 128) | (np.arange(256) == ord("<"))
_FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
#: Longest word, in bytes, that the table holds.
SHORT = 15


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Words:
    """Words of up to 15 bytes, told apart by all their bytes and their length, with place and number of their ids."""

    def __init__(self) -> None:
        self.columns = [np.zeros(0, t) for t in (np.uint64, np.uint64, np.uint64, np.int32, np.int32)]  # sort key, bytes 0-7, bytes 8-14 and length, place, number

    def find(self, key: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each word whether it is known, and its row."""
        keys, first, rest = self.columns[:3]
        if not len(keys):
            return np.zeros(len(key), bool), np.zeros(len(key), np.int64)
        row = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return (keys[row] == key) & (first[row] == a) & (rest[row] == b), row

    def add(self, rows: list[np.ndarray]) -> None:
        """Add words that aren't there."""
        order = np.argsort(rows[0])
        spots = np.searchsorted(self.columns[0], rows[0][order])
        for i, new in enumerate(rows):
            self.columns[i] = np.insert(self.columns[i], spots, new[order])


class WordEncoder:
    """Ids of texts, word by word.

    The tokenizer splits at white space before anything else, so the ids of a text are those of its
    blank-separated words in turn. It also lowers case and parts letters from marks, so an ASCII word
    shares its ids with its lower-case form, and a word that ends in an ASCII letter and a stop or comma
    has the ids of both. Words are cut, looked up and put together by arrays; a word is tokenised when it
    is first met.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        self.words, self.fresh, self.long = Words(), Words(), {}
        self.ids, self.used = np.zeros(1 << 16, np.uint16), 0

    def bound(self) -> None:
        """Hold the memory: words met lately join the others, and all go where that is too much."""
        if len(self.fresh.columns[0]) > 1 << 16:
            self.words.add(self.fresh.columns)
            self.fresh = Words()
        if sum(c.nbytes for c in self.words.columns) + 2 * self.used > MEMORY_BYTES or len(self.long) > 1 << 15:
            self.forget()

    def tokenized(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Place and number of the ids of words."""
        places, counts = np.zeros(len(words), np.int32), np.zeros(len(words), np.int32)
        for i in range(0, len(words), 4096):
            own = [e.ids for e in self.tokenizer.encode_batch_fast(words[i : i + 4096], add_special_tokens=False)]
            n = np.array([len(x) for x in own], np.int32)
            flat = np.fromiter((x for ids in own for x in ids), np.uint16, int(n.sum()))
            while self.used + len(flat) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            self.ids[self.used : self.used + len(flat)] = flat
            places[i : i + len(n)], counts[i : i + len(n)] = self.used + np.cumsum(n) - n, n
            self.used += len(flat)
        return places, counts

    def encode_bytes(self, text: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the white-space-separated pieces that begin at ``starts`` in a UTF-8 text, one after another, and the number of each."""
        self.bound()
        padded = text + b"\0" * 16
        raw = np.frombuffer(padded, np.uint8)
        lower = _LOWER[raw]
        edges = np.flatnonzero(np.diff(np.concatenate([[True], _GAP[raw[: len(text)]], [True]]).view(np.int8)))
        begin, end = edges[::2], edges[1::2]
        last = raw[end - 1]
        cut = (end - begin > 1) & ((last == ord(",")) | (last == ord("."))) & _LETTER[raw[end - 2]]
        # Units: a word, and its last mark after it where it has one.
        at = np.arange(len(begin)) + np.cumsum(cut) - cut
        lo, hi = np.zeros((2, len(begin) + int(cut.sum())), np.int64)
        lo[at], hi[at] = begin, end - cut
        lo[at[cut] + 1], hi[at[cut] + 1] = end[cut] - 1, end[cut]
        size = hi - lo
        kept = np.concatenate([[0], np.cumsum(_AS_IS[raw[: len(text)]], dtype=np.int32)])
        kept = kept[hi] > kept[lo]
        a, b = np.zeros((2, len(lo)), np.uint64)
        for which, source in ((kept, raw), (~kept, lower)):
            eight = np.ndarray(len(text) + 9, "<u8", source, strides=(1,))
            own = lo[which]
            a[which], b[which] = eight[own], eight[np.minimum(own + 8, len(text) + 8)]
        a &= _FIRST[np.minimum(size, 8)]
        b = b & _FIRST[np.clip(size - 8, 0, 7)] | np.minimum(size, 255).astype(np.uint64) << _U(56)
        key = _mix(a ^ _mix(b))
        place, count = np.zeros((2, len(lo)), np.int32)
        short = size <= SHORT
        left = np.flatnonzero(short)
        for table in (self.words, self.fresh):
            known, row = table.find(key[left], a[left], b[left])
            place[left[known]], count[left[known]] = table.columns[3][row[known]], table.columns[4][row[known]]
            left = left[~known]
        word = lambda i: (padded if kept[i] else lower)[lo[i] : hi[i]]
        one_by_one = np.flatnonzero(~short)
        if len(left):
            _, first, which = np.unique(key[left], return_index=True, return_inverse=True)
            new = left[first]
            same = (a[left] == a[new][which]) & (b[left] == b[new][which])
            places, counts = self.tokenized([bytes(word(i)).decode() for i in new.tolist()])
            self.fresh.add([key[new], a[new], b[new], places, counts])
            place[left], count[left] = places[which], counts[which]
            one_by_one = np.concatenate([one_by_one, left[~same]])  # words that share their sort key
        if len(one_by_one):
            words = [bytes(word(i)) for i in one_by_one.tolist()]
            if unknown := [w for w in dict.fromkeys(words) if w not in self.long]:
                for w, p, n in zip(unknown, *(x.tolist() for x in self.tokenized([w.decode() for w in unknown])), strict=True):
                    self.long[w] = (p, n)
            for i, w in zip(one_by_one.tolist(), words, strict=True):
                place[i], count[i] = self.long[w]
        spot = np.repeat(place - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        piece = np.searchsorted(starts, lo, "right") - 1
        return self.ids[spot], np.bincount(piece, count, len(starts)).astype(np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, one after another, and how many each has."""
        ids, counts = [], np.zeros(len(texts), np.int64)
        held, owners, size = [], [], 0

        def settle() -> None:
            nonlocal held, owners, size
            starts = np.cumsum([0, *(len(x) + 1 for x in held[:-1])])
            own, n = self.encode_bytes(b"\n".join(held), starts)
            ids.append(own)
            np.add.at(counts, owners, n)
            held, owners, size = [], [], 0

        for i, text in enumerate(texts):
            raw, at = text.encode(), 0
            while at < len(raw):
                stop = len(raw)
                if stop - at > PIECE_BYTES:
                    gap = next((m.start() for m in _GAPS.finditer(raw, at + PIECE_BYTES)), stop)
                    stop = gap
                held.append(raw[at:stop])
                owners.append(i)
                size, at = size + stop - at, stop
                if size >= PIECE_BYTES:
                    settle()
        if held:
            settle()
        return np.concatenate(ids) if ids else np.zeros(0, np.uint16), counts


def encoder(path: str) -> WordEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, ids (16-bit, with the end id), doc_tokens, and where the document stood: part, local_start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                own = batch.slice(lo, 256)
                flat, n = encoder(tokenizer_path).encode(own.column(1).to_pylist())
                flat = np.insert(flat, np.cumsum(n), end_id).astype("<u2")
                n = n + 1
                ends = np.cumsum(n)
                places = np.concatenate([[0], 2 * ends]).astype(np.int64)
                ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(places), pa.py_buffer(flat)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [own.column(0), ids, pa.array(n), pa.array(np.full(len(n), part, np.int64)), pa.array(at + ends - n)],
                    ["doc_id", "ids", "doc_tokens", "part", "local_start"],
                )
                at += int(ends[-1])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(
        run, "doc_id long, ids binary, doc_tokens long, part long, local_start long"
    )


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece (see PIECES), over the whole table."""
    if not 0 < window:
        raise ValueError("window must be positive")
    tokens = materialize(tokenize(docs, tokenizer_path, end_id), "packing-tokens")
    totals = tokens.groupBy("part").agg(F.sum("doc_tokens").alias("total"))
    # One row per partition of the input, so a single ordered window holds them.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    # Bases are as many as the input has partitions: small whatever the documents hold.
    placed = tokens.join(F.broadcast(bases), "part").select("doc_id", "ids", "doc_tokens", (F.col("base") + F.col("local_start")).alias("at"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                own = batch.slice(lo, 512)
                at, n = (own.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 2))
                pieces = (at + n - 1) // window - at // window + 1
                row = np.repeat(np.arange(len(n)), pieces)
                k = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                lower = np.maximum(at[row], (at[row] // window + k) * window)
                upper = np.minimum(at[row] + n[row], (lower // window + 1) * window)
                start = lower - at[row]
                ids = own.column(1).to_pylist()
                wide = [np.frombuffer(x, "<u2").astype("<u4") for x in ids]
                crc = [zlib.crc32(wide[r][s : s + m]) for r, s, m in zip(row.tolist(), start.tolist(), (upper - lower).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [own.column(0).take(pa.array(row)), *(pa.array(x, pa.int64()) for x in (start, upper - lower, crc, n[row], lower // window, lower % window))],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
                )

    return placed.mapInArrow(cut, PIECES)
