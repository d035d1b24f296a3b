"""Token alignment against sets of offsets, with another library's encoder for A."""

import base64
import hashlib
import random
from collections import Counter

import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken

from tests.conftest import SF
from tests.llm.helpers import docs
from tidemark.llm import alignment
from tidemark.llm.queries import ALIGNED, op12_alignment, tokenizer_path

COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def plain(texts):
    """The whole operator again, by plain loops."""
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    left = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    right = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    links, rows = [], []
    for text in texts:
        found, own = [], []
        a = left.encode_ordinary(" " + (text or "")) if text else []
        b = right.encode(text) if text else []
        bytes_a = [left.decode_single_token_bytes(i) for i in a]
        bytes_b = [bytes([int(p[3:5], 16)]) if right.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, right.id_to_piece(i)) for i in b)]
        if not text or b"".join(bytes_a) != b" " + text.encode() or b"".join(bytes_b) != b" " + text.encode():
            rows.append((0, 0, 0, ""))
            links.append([])
            continue

        def ends(parts):
            at, out = 0, []
            for p in parts:
                at += len(p)
                out.append(at)
            return out

        ends_a, ends_b = ends(bytes_a), ends(bytes_b)
        last_a = last_b = 0
        for stop in sorted(set(ends_a) & set(ends_b)):
            i, j = ends_a.index(stop, last_a) + 1, ends_b.index(stop, last_b) + 1
            found.append(",".join(map(str, a[last_a:i])) + "|" + ",".join(map(str, b[last_b:j])))
            own.append((a[i - 1], b[j - 1]))
            last_a, last_b = i, j
        rows.append((len(a), len(b), len(found), hashlib.sha256(";".join(found).encode()).hexdigest()))
        links.append(own)
    counts = Counter(x for own in links for x in own)
    highest = {}
    for (_, b), n in counts.items():
        highest[b] = max(highest.get(b, 0), n)
    return [(i, na, nb, n, len(own), sum(counts[x] == highest[x[1]] for x in own), sum(counts[x] for x in own), sha) for i, ((na, nb, n, sha), own) in enumerate(zip(rows, links, strict=True))]


def awkward():
    r = random.Random(5)
    texts = [None, "", " ", "  two  spaces ", "a", "Hello world", "Hello world", "<|endoftext|> and <s> </s> <unk> <0x41>", "▁ marks", "tab\tand\nlines\r\n\n", "\0 nul", "naïve café ﬁ ①", "日本語 の テキスト", "😀 👩‍👩‍👧 flags 🇫🇷"]
    texts += ["x" * 3000, "word " * 4000, "é" * 1500, "1234567890 " * 50, "   ", "don't we'll I'm", " nbsp　wide", "é combining", "﻿bom", "‮right"]
    alphabet = "ab cdé ñ\n\t  日😀'0123,.-_<>|▁"
    texts += ["".join(r.choice(alphabet) for _ in range(r.randrange(1, 80))) for _ in range(300)]
    return texts


@pytest.mark.parametrize(("hot", "at_once"), [(alignment.HOT, 1 << 20), (0, 50), (7, 1 << 20)])
def test_awkward_texts(spark, monkeypatch, hot, at_once):
    monkeypatch.setattr(alignment, "AT_ONCE", at_once)
    texts = awkward()
    df = docs(spark, texts).repartition(3).withColumnsRenamed({"bucket": "pair", "part": "row", "key": "links"})
    out = alignment.align(df, *map(tokenizer_path, ALIGNED), hot=hot)
    assert tuple(out.columns) == COLUMNS
    got, want = sorted(map(tuple, out.collect())), plain(texts)
    assert got == want
    assert sum(r[1] == 0 for r in want) >= 3 and sum(r[3] < min(r[1], r[2]) for r in want) > 50


def test_both_encoders_of_a():
    """The encoder by ranks gives the ids of the tokenizer's own; long blanks go to the latter."""
    own = alignment.Sides(*map(tokenizer_path, ALIGNED))
    assert own.fast is not None
    r = random.Random(6)
    alphabet = "abcdeß '\n\t\u3000\u00a0日😀0１²½,.-_<|>‍\u0301ǅªºʰ٣\x1c\x85"
    texts = [t for t in awkward() if t] + ["".join(r.choice(alphabet) for _ in range(r.randrange(1, 60))) for _ in range(20_000)] + [" " * 100_000 + "a", "\n" * 700 + "b", "xy" * 100_000]
    for t in texts:
        assert own.left_ids(t) == own.a.encode(" " + t, add_special_tokens=False).ids


def test_null_ids_and_no_rows(spark):
    df = spark.createDataFrame([(None, "one two"), (None, "one two"), (3, None)], "doc_id long, text string")
    a, b, c = sorted(map(tuple, alignment.align(df, *map(tokenizer_path, ALIGNED)).collect()), key=lambda r: r[0] or 0)
    assert a == b and a[0] is None and a[6] == 2 * a[4] and c == (3, 0, 0, 0, 0, 0, 0, "")
    assert alignment.align(docs(spark, []), *map(tokenizer_path, ALIGNED)).collect() == []


def test_query_by_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    want = [(rows[w[0]].doc_id, *w[1:]) for w in plain([r.text for r in rows])]
    assert sorted(map(tuple, op12_alignment(spark, SF).collect())) == sorted(want)
