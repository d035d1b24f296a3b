import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import docs
from tidemark.llm import prefixhash as ph


def test_spans_and_extensions():
    r = random.Random(5)
    for _ in range(30):
        a = "".join(r.choice("abé😀") for _ in range(r.randrange(1, 60)))
        b = a[: r.randrange(len(a) + 1)] + "".join(r.choice("abé") for _ in range(9))
        x, y = ph.PrefixHash(a), ph.PrefixHash(b)
        for _ in range(40):
            i, j = r.randrange(len(a)), r.randrange(len(b))
            n = r.randrange(min(len(a) - i, len(b) - j) + 1)
            assert x.equal(i, j, n, y) == (a[i : i + n] == b[j : j + n])
            want = next((k for k in range(min(len(a) - i, len(b) - j)) if a[i + k] != b[j + k]), min(len(a) - i, len(b) - j))
            assert x.extension(i, j, y) == want
        assert x.windows(1).tolist() == [x.span(i, i + 1) for i in range(len(a))]


def test_common_start(monkeypatch):
    monkeypatch.setattr(ph, "BLOCK", 7)
    for a, b, n in (("", "", 0), ("abc", "abd", 2), ("x" * 30, "x" * 21, 21), ("x" * 14 + "y", "x" * 14 + "z", 14)):
        assert ph.common_start(a, b) == n


def test_fingerprint_by_brute_force(monkeypatch):
    monkeypatch.setattr(ph, "BLOCK", 100)
    r = random.Random(6)
    for n in (0, 1, 31, 32, 33, 400, 1000):
        t = "".join(r.choice("abcdef ") for _ in range(n))
        spans = {t[i : i + ph.SPAN] for i in range(max(1, n - ph.SPAN + 1))} if n else set()
        want = sorted(ph.PrefixHash(s).span(0, len(s)) for s in spans)[: ph.KEPT]
        assert ph.fingerprint(t).tolist() == want
        assert ph.from_hex(ph.to_hex(ph.fingerprint(t))).tolist() == want
    assert ph.likeness(ph.fingerprint(""), ph.fingerprint("")) == 1.0
    assert ph.likeness(ph.fingerprint(""), ph.fingerprint("x")) == 0.0
    assert len(ph.fingerprint("a" * 1000)) == 1


def test_likeness_follows_jaccard():
    r = random.Random(7)
    a = "".join(r.choice("abcdefghij ") for _ in range(3000))
    b = a[:2000] + "".join(r.choice("abcdefghij ") for _ in range(1000))
    spans = [{t[i : i + ph.SPAN] for i in range(len(t) - ph.SPAN + 1)} for t in (a, b)]
    true = len(spans[0] & spans[1]) / len(spans[0] | spans[1])
    assert abs(ph.likeness(ph.fingerprint(a), ph.fingerprint(b)) - true) < 0.2


def brute(rows):
    order = sorted(rows, key=lambda x: -x[0])
    out = {}
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1] or ""
        t = t or ""
        third = len(t) // 3
        e = t[: len(t) - third] + following[:third]
        f = [ph.fingerprint(x) for x in (t, e, following)]
        out[i] = (len(t), hashlib.sha256(e.encode()).hexdigest(), ph.to_hex(f[0]), ph.to_hex(f[1]), ph.likeness(f[0], f[1]), ph.likeness(f[0], f[2]))
    return out


def test_query(spark, monkeypatch):
    r = random.Random(8)
    texts = ["", None, "a", "ab", "😀é" * 50, "long " * 40_000] + ["".join(r.choice("abc d") for _ in range(r.randrange(300))) for _ in range(60)]
    rows = [(7 * i - 50, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, range int, fingerprint string")
    for own, size in ((rows, 100), (rows, 10**7), (rows[:1], 1), (rows[:2], 1)):
        monkeypatch.setattr(ph, "RANGE_BYTES", size)
        got = ph.compare_edited(df.where(df.doc_id.isin([i for i, _ in own])))
        assert {x.doc_id: tuple(x)[1:7] for x in got.collect()} == brute(own)
    assert ph.compare_edited(docs(spark, [])).count() == 0


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (None, "n"), (None, None)], "doc_id long, text string")
    rows = ph.compare_edited(df).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in rows) == [(0, 0), (0, 1), (1, 1), (1, 1), (1, 1)]
    assert np.all([r.fingerprint == r.edited_fingerprint for r in rows if r.n_chars < 3])


@pytest.mark.parametrize("size", [10, 200, 10**6])
def test_hot_ids_go_to_several_ranges(spark, size):
    """Every row but a guest is followed by the next in one order of all rows, however many share an id."""
    r = random.Random(3)
    rows = [(r.choice([None, 5, 5, 5, 9, *range(20, 40)]), "t" * r.randrange(9) + str(i % 150)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    dealt = ph.in_order(df, size)
    parts = {}
    for x in dealt.withColumn("tie", F.xxhash64("text")).collect():
        parts.setdefault(x.range, []).append(x)
    key = lambda x: (x.doc_id is None, -(x.doc_id or 0), x.tie)
    order = [x for k in sorted(parts) for x in parts[k] if not x.guest]
    assert [key(x) for x in order] == sorted(map(key, order)) and len(order) == len(rows)
    for i, k in enumerate(sorted(parts)):
        guests = [x for x in parts[k] if x.guest]
        following = sorted(parts)[(i + 1) % len(parts)]
        assert len(guests) == 1 and key(guests[0]) == key(parts[following][0])
    if size == 10:
        most = max(sum(not x.guest for x in p) for p in parts.values())
        assert len(parts) > 30 and most < 40
