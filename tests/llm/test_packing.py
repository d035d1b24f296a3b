import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.conftest import SF
from tests.llm.helpers import docs
from tidemark.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(df, texts, window):
    tok = Tokenizer.from_file(PATH)
    ids = {i: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t in texts.items()}
    rows = sorted(df.collect(), key=lambda r: (r.sequence_id, r.offset))
    at = dict.fromkeys(ids, 0)
    stream = 0
    for r in rows:
        assert r.sequence_id * window + r.offset == stream
        stream += r.length
        assert r.offset + r.length <= window
        assert r.start == at[r.doc_id]
        at[r.doc_id] += r.length
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
    assert at == {i: len(x) for i, x in ids.items()}


def test_awkward(spark):
    texts = ["", None, "It's the end's  'tis\x1cx y", "a b\tc\n\nd", "<|endoftext|> x", "Ⅷ①½ é ΑΣ Σ ß", "word " * 3000, "don't,,,!! 1234 'sx", "BİLGİ, İ. <|ENDOFTEXT|> a<|endoftext|>b, x" + "y" * 40]
    check(packing.pack(docs(spark, texts).repartition(3), PATH, 64), dict(enumerate(texts)), 64)
    assert packing.pack(docs(spark, []), PATH).count() == 0


PARTS = ["<|endoftext|>", "<|ENDOFTEXT|>", "İ", "BİLGİ", ",", ".", "a", "B", "É", "ΑΣ", "ß", "😀", "1", "'s", "'S", " ", "\n", "\u00a0", "\x00", "<", "x" * 15, "y" * 16, "Ⅷ", "K", "中文", "the", "a,", "\u0301", "\u0307", "\x0b"]


@pytest.mark.parametrize("memory", [packing.MEMORY_BYTES, 20_000])
def test_random_strings(monkeypatch, memory):
    monkeypatch.setattr(packing, "MEMORY_BYTES", memory)
    monkeypatch.setattr(packing, "PIECE_BYTES", 300)
    r, tok, encoder = random.Random(memory), Tokenizer.from_file(PATH), packing.WordEncoder(PATH)
    for _ in range(40):
        texts = ["".join(r.choice(PARTS) if r.random() < 0.9 else chr(r.randrange(32, 0x3000)) for _ in range(r.randrange(40))) for _ in range(100)]
        flat, n = encoder.encode(texts)
        ends = np.cumsum(n)
        assert [flat[e - k : e].tolist() for e, k in zip(ends, n, strict=True)] == [x.ids for x in tok.encode_batch(texts, add_special_tokens=False)]


def test_null_and_repeated_ids(spark):
    df = docs(spark, ["one two", "three", None, "one two"]).selectExpr("if(doc_id = 2, null, 1L) as doc_id", "text", "source")
    rows = packing.pack(df.repartition(2), PATH, 4).collect()
    assert sum(r.length for r in rows) == 3 + 2 + 1 + 3
    assert sorted((r.doc_tokens, r.doc_id) for r in rows if r.start == 0) == [(1, None), (2, 1), (3, 1), (3, 1)]


def test_whole_table(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    check(packing.pack(df.repartition(4), PATH), {r.doc_id: r.text for r in df.collect()}, 4096)
