import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from tests.conftest import SF
from tests.llm.helpers import docs
from tidemark.llm import media


def pack_codes(codes):
    """Codes of given widths, least significant bit first."""
    value, at = 0, 0
    for code, width in codes:
        value |= code << at
        at += width
    return value.to_bytes((at + 7) // 8, "little")


def test_lzw_round_trip():
    r = random.Random(1)
    for n in (0, 1, 2, 3, 255, 5000, 70_000):
        for symbols in (1, 2, 256):
            data = bytes(r.randrange(symbols) for _ in range(n))
            assert media.lzw_decode(media.lzw_encode(data), 8) == data


def test_lzw_known_stream():
    # clear, 1, 6 (the code being defined), 1, end at two-bit samples
    assert media.lzw_decode(pack_codes([(4, 3), (1, 3), (6, 3), (1, 3), (5, 4)]), 2) == bytes([1, 1, 1, 1])


def test_lzw_full_table_without_clear():
    """A stream may go on with a full table of 12-bit codes."""
    r = random.Random(2)
    codes, nxt, width = [(256, 9)], 258, 9
    data = [r.randrange(256) for _ in range(9000)]
    for i, s in enumerate(data):
        codes.append((s, width))
        if i:
            nxt = min(nxt + 1, 4096)
        width = min(12, max(9, nxt.bit_length()))
    codes.append((257, width))
    assert media.lzw_decode(pack_codes(codes), 8) == bytes(data)


def test_payload_round_trip_over_frames():
    payload = bytes(range(256)) * 40
    data = media.encode_payload(payload, rows=16, delay_cs=5)
    got = list(media.decode(data))
    assert b"".join(map(media.payload_of, got)) == payload
    assert [f.start_ms for f in got] == [50 * i for i in range(10)]
    assert sum(f.histogram().sum() for f in got) == len(payload)


def gif(frames, width=2, height=2, background=0):
    palette = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    out = b"GIF89a" + struct.pack("<HHBBB", width, height, 0x81, background, 0) + palette
    for disposal, transparent, (x, y, w, h), samples in frames:
        out += b"!\xf9\x04" + struct.pack("<BHBB", disposal << 2 | (transparent is not None), 10, transparent or 0, 0)
        codes = media.lzw_encode(bytes(samples), 2)
        out += b"," + struct.pack("<HHHHB", x, y, w, h, 0) + b"\x02" + bytes([len(codes)]) + codes + b"\0"
    return out + b";"


def test_disposal_and_transparency():
    black, red, green, blue = [0, 0, 0], [255, 0, 0], [0, 255, 0], [0, 0, 255]
    data = gif([(1, None, (0, 0, 2, 2), [1, 1, 1, 1]), (3, 0, (0, 0, 2, 1), [0, 2]), (2, None, (1, 1, 1, 1), [3]), (0, 3, (0, 0, 1, 1), [3])])
    shown = [f.canvas.reshape(-1, 3).tolist() for f in media.decode(data)]
    assert shown == [[red] * 4, [red, green, red, red], [red, red, red, blue], [red, red, red, black]]
    assert [f.disposal for f in media.decode(data)] == [1, 3, 2, 0]


def test_malformed():
    good = media.encode_payload(bytes(64))
    for bad in (b"", b"PNG", good[:40], good[:-20]):
        with pytest.raises(ValueError):
            list(media.decode(bad))


def test_query_on_awkward_texts(spark):
    texts = ["", None, "a", "a", "é" * 63, "x" * 300_000, "\0\0"]
    rows = {r.doc_id: r for r in media.read_media(media.text_media(docs(spark, texts))).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert sum(map(int, r.feature.split(","))) == len(payload) and r.error is None
    assert rows[2].media_sha256 == rows[3].media_sha256
    assert rows[5].n_frames == 2
    assert media.read_media(media.text_media(docs(spark, []))).count() == 0


def test_frames(spark):
    df = media.text_media(docs(spark, ["x" * 300_000, "b"]))
    rows = media.frames(df, pixels=True).orderBy("key", "frame").collect()
    assert [(r.key, r.frame, r.start_ms) for r in rows] == [(0, 0, 0), (0, 1, 40), (1, 0, 0)]
    assert all(sum(r.histogram) == len(r.rgb) // 3 for r in rows)
    assert np.frombuffer(rows[2].rgb, np.uint8)[:3].tolist() == media.PALETTE[ord("b")].tolist()


def test_malformed_media_in_a_column(spark):
    good = media.encode_payload(b"payload " * 16)
    huge = b"GIF89a" + struct.pack("<HHBBB", 65535, 65535, 0, 0, 0) + b";"
    late = media.encode_payload(bytes(range(256)) * 8, rows=16)[:-30]  # its last frame is cut
    made = [(0, good), (1, b"PNG"), (2, good[:40]), (3, huge), (4, None), (5, late), (5, good)]
    df = spark.createDataFrame([(i, bytearray(m) if m is not None else None) for i, m in made], "doc_id long, media binary")
    rows = media.read_media(df).collect()
    assert [(r.doc_id, r.payload_bytes) for r in rows if r.error is None] == [(0, 128), (4, None), (5, 128)]
    assert {r.doc_id for r in rows if r.error} == {1, 2, 3, 5} and all(r.payload_sha256 is None for r in rows if r.error)
    assert "too large" in next(r.error for r in rows if r.doc_id == 3)
    shown = media.frames(df).collect()
    assert {(r.key, r.frame is None) for r in shown if r.key in (1, 2, 3)} == {(1, True), (2, True), (3, True)}
    assert sum(r.error is None for r in shown if r.key == 5) == 2 and 4 not in {r.key for r in shown}


def test_whole_table(spark):
    """Every whole text comes back from its stored media, byte for byte."""
    df = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: (r.text or "").encode() for r in df.select("doc_id", "text").collect()}
    rows = media.read_media(media.text_media(df)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        payload = texts[r.doc_id] + bytes(-len(texts[r.doc_id]) % 64 if texts[r.doc_id] else 64)
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        colours = np.bincount(_bins(payload), minlength=media.BINS)
        assert r.feature == ",".join(map(str, colours.tolist()))


def _bins(payload):
    c = media.PALETTE[np.frombuffer(payload, np.uint8)] >> 6
    return c[:, 0] << 4 | c[:, 1] << 2 | c[:, 2]


def test_expanding_stream_is_stopped(spark):
    """A small file whose codes stand for twenty million samples on a screen of one pixel."""
    bomb = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0xF7, 0, 0) + bytes(768) + b"," + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x08"
    codes = media.lzw_encode(bytes(20_000_000))
    bomb += b"".join(bytes([len(b)]) + b for b in (codes[i : i + 255] for i in range(0, len(codes), 255))) + b"\0;"
    assert len(bomb) < 40_000
    with pytest.raises(ValueError, match="too many samples"):
        list(media.decode(bomb))
    rows = media.read_media(spark.createDataFrame([(1, bomb)], "doc_id long, media binary")).collect()
    assert "too many samples" in rows[0].error and rows[0].feature is None
    assert media.lzw_decode(media.lzw_encode(b"abcabc"), 8, 6) == b"abcabc"
