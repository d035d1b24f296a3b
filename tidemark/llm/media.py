"""Media columns: GIF.

``encode_payload`` lays bytes out as the pixels of a paletted, timed GIF; ``decode`` reads any GIF87a
or GIF89a: LZW code streams, global and local palettes, interlacing, transparency, and the disposal
rules, giving composited frames with start time, delay and a colour histogram. ``read_media`` and
``frames`` apply it to a column.

Edge cases: null media give no frames and null features; a null text counts as empty, whose payload is
64 zero bytes; equal texts give equal media and repeated rows are rows of their own. ``decode`` raises
ValueError for a truncated or malformed stream, or one whose screen is larger than ``MAX_PIXELS`` (a
parameter); in a column such media get null features, or no further frames, and a text in ``error``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_or_empty

WIDTH = 64
ROWS_PER_FRAME = 4096
DELAY_CS = 4
BINS = 64
#: Pixels of the largest screen that is decoded (three bytes each).
MAX_PIXELS = 1 << 24

_LIMIT = 4096
#: Colour of sample rrrgggbb: its bits in the high bits of each channel, so that a colour names its sample.
PALETTE = np.stack([(i := np.arange(256)) & 0xE0, (i << 3) & 0xE0, (i << 6) & 0xC0], 1).astype(np.uint8)


def _offsets(min_size: int) -> np.ndarray:
    """Bit offsets of the codes that follow a clear code: a width depends only on a code's place."""
    first = (1 << min_size) + 2
    nxt = np.minimum(first + np.maximum(np.arange(2 * _LIMIT) - 1, 0), _LIMIT - 1)
    width = np.maximum(min_size + 1, np.floor(np.log2(nxt)).astype(np.int64) + 1)
    return np.concatenate([[0], np.cumsum(width)])


_OFFSETS = {m: _offsets(m) for m in range(2, 9)}


def lzw_encode(data: bytes, min_size: int = 8) -> bytes:
    """Codes of a run of samples; the table is cleared whenever it is full."""
    clear, end, first = 1 << min_size, (1 << min_size) + 1, (1 << min_size) + 2
    runs, codes, table, nxt = [], [], {}, first
    if data:
        prefix = data[0]
        for sample in data[1:]:
            key = prefix << 8 | sample
            code = table.get(key)
            if code is not None:
                prefix = code
                continue
            codes.append(prefix)
            table[key] = nxt
            nxt += 1
            prefix = sample
            if nxt == _LIMIT:
                runs.append([*codes, clear])
                codes, table, nxt = [], {}, first
        codes.append(prefix)
    runs.append([*codes, end])
    offsets = _OFFSETS[min_size]
    values, starts, at = [np.array([clear])], [np.array([0])], min_size + 1
    for run in runs:
        values.append(np.array(run))
        starts.append(at + offsets[: len(run)])
        at += offsets[len(run)]
    value, start = np.concatenate(values).astype(np.uint32), np.concatenate(starts)
    out = np.zeros((at + 7) // 8 + 3, np.uint32)
    value = value << (start & 7).astype(np.uint32)
    for k in range(3):  # a code touches three bytes at most, and the codes of one byte share no bit of it
        np.add.at(out, (start >> 3) + k, (value >> np.uint32(8 * k)) & np.uint32(255))
    return out[: (at + 7) // 8].astype(np.uint8).tobytes()


def lzw_decode(stream: bytes, min_size: int, most: int | None = None) -> bytes:
    """The samples of a code stream; more of them than ``most`` raise an error before they are put together."""
    clear, end = 1 << min_size, (1 << min_size) + 1
    raw, bits = np.frombuffer(stream + b"\0" * 4, np.uint8).astype(np.uint32), 8 * len(stream)
    offsets, literals = _OFFSETS[min_size], [bytes([i]) for i in range(clear)] + [b"", b""]
    out: list[bytes] = []
    at, table, prev = 0, literals.copy(), None
    size = 0
    base = 0  # place, since the last clear code, of the code at ``at``
    while at + min_size < bits:
        span = offsets[base : base + _LIMIT + 1] - offsets[base]
        pos = at + span[:-1]
        width = np.diff(span)
        fit = pos + width <= bits
        pos, width = pos[fit], width[fit].astype(np.uint32)
        if not len(pos):
            break
        byte = pos >> 3
        code = (raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (pos & 7).astype(np.uint32) & ((np.uint32(1) << width) - np.uint32(1))
        stop = np.flatnonzero((code == clear) | (code == end))
        n = int(stop[0]) if len(stop) else len(code)
        for c in code[:n].tolist():
            if prev is None:
                entry = table[c]
            else:
                if c < len(table):
                    entry = table[c]
                elif c == len(table) < _LIMIT:
                    entry = prev + prev[:1]
                else:
                    raise ValueError("LZW code beyond the table")
                if len(table) < _LIMIT:
                    table.append(prev + entry[:1])
            out.append(entry)
            size += len(entry)
            prev = entry
            if most is not None and size > most:
                raise ValueError("frame with too many samples")
        if not len(stop):
            at, base = at + int(span[n]), min(base + n, _LIMIT)  # widths no longer change beyond
            continue
        if code[n] == end:
            break
        at, base, table, prev = at + int(span[n + 1]), 0, literals.copy(), None
    return b"".join(out)


def encode_payload(payload: bytes, width: int = WIDTH, rows: int = ROWS_PER_FRAME, delay_cs: int = DELAY_CS) -> bytes:
    """A GIF whose frames show the payload, a positive multiple of the width, row by row."""
    if not payload or len(payload) % width:
        raise ValueError("the payload must be a positive multiple of the width")
    size = width * rows
    height = min(rows, len(payload) // width)
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), PALETTE.tobytes(), b"!\xff\x0bNETSCAPE2.0\x03\x01\0\0\0"]
    for lo in range(0, len(payload), size):
        part = payload[lo : lo + size]
        codes = lzw_encode(part)
        out.append(b"!\xf9\x04" + struct.pack("<BHBB", 1 << 2, delay_cs, 0, 0) + b"," + struct.pack("<HHHHB", 0, 0, width, len(part) // width, 0) + b"\x08")
        out += [bytes([len(b)]) + b for b in (codes[i : i + 255] for i in range(0, len(codes), 255))]
        out.append(b"\0")
    return b"".join([*out, b";"])


@dataclass
class Frame:
    index: int
    start_ms: int
    delay_ms: int
    left: int
    top: int
    width: int
    height: int
    disposal: int
    transparent: int | None
    canvas: np.ndarray  # height x width x 3 of the whole screen, as shown

    def histogram(self, whole: bool = True) -> np.ndarray:
        """Colours of the whole screen, or of the frame's own area."""
        c = (self.canvas if whole else self.area()) >> 6
        return np.bincount((c[..., 0] << 4 | c[..., 1] << 2 | c[..., 2]).ravel(), minlength=BINS)

    def area(self) -> np.ndarray:
        return self.canvas[self.top : self.top + self.height, self.left : self.left + self.width]


def decode(data: bytes, max_pixels: int = MAX_PIXELS) -> Iterator[Frame]:
    """Frames of a GIF as shown, one at a time; each canvas is the frame's own copy."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    view = memoryview(data)
    try:
        yield from _decode(data, view, max_pixels)
    except (IndexError, struct.error) as e:
        raise ValueError("truncated GIF") from e


def _blocks(view: memoryview, at: int) -> tuple[bytes, int]:
    parts = []
    while n := view[at]:
        parts.append(view[at + 1 : at + 1 + n])
        at += 1 + n
    return b"".join(parts), at + 1


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray, int]:
    n = 3 << ((flags & 7) + 1)
    if at + n > len(data):
        raise ValueError("truncated palette")
    table = np.zeros((256, 3), np.uint8)
    table[: n // 3] = np.frombuffer(data[at : at + n], np.uint8).reshape(-1, 3)
    return table, at + n


def _decode(data: bytes, view: memoryview, max_pixels: int) -> Iterator[Frame]:
    width, height, flags, background, _ = struct.unpack_from("<HHBBB", data, 6)
    if width * height > max_pixels:
        raise ValueError("screen too large")
    at, shared = 13, None
    if flags & 0x80:
        shared, at = _palette(data, at, flags)
    ground = shared[background] if shared is not None else np.zeros(3, np.uint8)
    canvas = np.empty((height, width, 3), np.uint8)
    canvas[:] = ground
    disposal, delay, transparent, index, clock = 0, 0, None, 0, 0
    while (kind := view[at]) != 0x3B:
        if kind == 0x21:
            body, end = _blocks(view, at + 2)
            if view[at + 1] == 0xF9 and len(body) >= 4:
                disposal, delay = body[0] >> 2 & 7, 10 * (body[1] | body[2] << 8)
                transparent = body[3] if body[0] & 1 else None
            at = end
            continue
        if kind != 0x2C:
            raise ValueError("unknown GIF block")
        left, top, w, h, local = struct.unpack_from("<HHHHB", data, at + 1)
        at, colours = at + 10, shared
        if local & 0x80:
            colours, at = _palette(data, at, local)
        if colours is None:
            raise ValueError("frame without a palette")
        if left + w > width or top + h > height:  # the screen grows to hold the frame
            if max(width, left + w) * max(height, top + h) > max_pixels:
                raise ValueError("screen too large")
            grown = np.empty((max(height, top + h), max(width, left + w), 3), np.uint8)
            grown[:] = ground
            grown[:height, :width] = canvas
            canvas, (height, width) = grown, grown.shape[:2]
        size = view[at]
        if not 2 <= size <= 8:
            raise ValueError("LZW code size")
        codes, at = _blocks(view, at + 1)
        samples = np.frombuffer(lzw_decode(codes, size, w * h), np.uint8)
        if len(samples) < w * h:
            raise ValueError("frame with too few samples")
        samples = samples.reshape(h, w)
        if local & 0x40:
            rows = np.concatenate([np.arange(s, h, d) for s, d in ((0, 8), (4, 8), (2, 4), (1, 2))])
            plain = np.empty_like(samples)
            plain[rows] = samples
            samples = plain
        before = canvas.copy() if disposal == 3 else None
        area = canvas[top : top + h, left : left + w]
        if transparent is None:
            area[:] = colours[samples]
        else:
            shown = samples != transparent
            area[shown] = colours[samples[shown]]
        yield Frame(index, clock, delay, left, top, w, h, disposal, transparent, canvas.copy())
        if disposal == 2:
            area[:] = ground
        elif disposal == 3:
            canvas = before
        index, clock = index + 1, clock + delay
        disposal, delay, transparent = 0, 0, None


def payload_of(frame: Frame) -> bytes:
    """The samples that a frame of ``encode_payload`` shows."""
    c = frame.area()
    return (c[..., 0] | c[..., 1] >> 3 | c[..., 2] >> 6).tobytes()


def text_media(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_bytes and the GIF of every whole text's UTF-8 bytes, padded with zeros to a positive multiple of the width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                own = batch.slice(lo, 256)
                raw = [x.encode() for x in own.column(1).to_pylist()]
                media = [encode_payload(x + b"\0" * (-len(x) % width if x else width), width) for x in raw]
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


READ = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames int, duration_ms long, error string"


def _features(data: bytes, max_pixels: int) -> tuple:
    digest, n, tail, bins, count, lasts = hashlib.sha256(), 0, b"", np.zeros(BINS, np.int64), 0, 0
    for frame in decode(data, max_pixels):
        part = payload_of(frame)
        digest.update(part)
        n, tail = n + len(part), (tail + part)[-64:]
        bins += frame.histogram(whole=False)
        count, lasts = count + 1, frame.start_ms + frame.delay_ms
    return n, digest.hexdigest(), zlib.crc32(tail), len(data), hashlib.sha256(data).hexdigest(), ",".join(map(str, bins.tolist())), count, lasts, None


def read_media(df: DataFrame, max_pixels: int = MAX_PIXELS) -> DataFrame:
    """Decode the media column frame by frame; the other columns stay. The feature is the summed colour histogram of the frames' own areas."""
    keep = [f for f in df.schema.fields if f.name != "media"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for media in batch.column("media"):
                data = media.as_py()
                if data is None:
                    rows.append((None,) * 9)
                    continue
                try:
                    rows.append(_features(data, max_pixels))
                except ValueError as e:
                    rows.append((*(None,) * 8, str(e)))
            new = list(zip(*rows, strict=True)) if rows else [[]] * 9
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keep), *(pa.array(list(x), k) for x, k in zip(new, kinds, strict=True))], [*(f.name for f in keep), *(x.split()[0] for x in READ.split(", "))])

    return df.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + [READ]))


def frames(df: DataFrame, key: str = "doc_id", pixels: bool = False, max_pixels: int = MAX_PIXELS) -> DataFrame:
    """A row per frame: key, index, timing, place, disposal, 64-bin colour histogram and, if asked for, the RGB bytes of the screen.

    Media that can't be decoded, or not to their end, have a last row without a frame whose ``error`` says why.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, media in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if (data := media.as_py()) is None:
                    continue
                try:
                    for f in decode(data, max_pixels):
                        yield pa.RecordBatch.from_pylist(
                            [{"key": k, "frame": f.index, "start_ms": f.start_ms, "delay_ms": f.delay_ms, "left": f.left, "top": f.top, "width": f.width, "height": f.height, "disposal": f.disposal, "transparent": f.transparent, "histogram": f.histogram().tolist(), "rgb": f.canvas.tobytes() if pixels else None}],
                            SCHEMA,
                        )
                except ValueError as e:
                    yield pa.RecordBatch.from_pylist([{"key": k, "error": str(e)}], SCHEMA)

    i32 = pa.int32()
    SCHEMA = pa.schema([("key", pa.int64()), ("frame", i32), ("start_ms", pa.int64()), ("delay_ms", pa.int64()), *((x, i32) for x in ("left", "top", "width", "height", "disposal", "transparent")), ("histogram", pa.list_(pa.int64())), ("rgb", pa.binary()), ("error", pa.string())])
    return df.select(F.col(key).cast("long").alias("key"), "media").mapInArrow(
        run, "key long, frame int, start_ms long, delay_ms long, `left` int, top int, width int, height int, disposal int, transparent int, histogram array<long>, rgb binary, error string"
    )
