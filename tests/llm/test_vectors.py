"""Hard negatives and exact top-k against plain searches."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import negatives, topk, vectors

SCHEMA = "id long, label int, vector array<float>, row string, list int, norm int"


def table(seed, n=400, width=12, spread=1.0):
    """Clusters, a hot vector, ties, repeated rows, short vectors, zeros, and rows that take no part."""
    r = random.Random(seed)
    centers = [[r.gauss(0, 1) for _ in range(width)] for _ in range(6)]
    rows = []
    for i in range(n):
        c = r.choice(centers)
        v = [float(np.float32(x + r.gauss(0, 0.2))) * (spread ** r.random()) for x in c]
        rows.append([i, r.randrange(3), v])
    for i in range(0, n, 3):
        rows[i][2] = list(rows[0][2])  # a third of all rows
    rows[5][2], rows[6][2], rows[20][2] = [], [0.5] * (width - 4), [0.0] * width
    rows[7][2], rows[8][1], rows[9][0], rows[10][2] = None, None, None, [None] + [1.0] * (width - 1)
    rows[11][2], rows[13][2], rows[14][2] = [math.nan] * width, [math.inf] * width, [1e30] * width
    rows += [list(x) for x in rows[40:60]] + [list(rows[30]), list(rows[30])]
    return [(i, k, v, "x", 1, 2) for i, k, v in rows]


def whole(rows, scale):
    out = []
    for i, k, v, *_ in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        v = [math.floor(scale * float(np.float32(x))) for x in v]
        if sum(x * x for x in v) < vectors.TOO_LONG:
            out.append((i, k, v))
    return out


def product(a, b):
    return sum(x * y for x, y in zip(a, b, strict=False))


def plain_negatives(rows):
    kept = [r for r in whole(rows, 256) if r[1] is not None]
    out = []
    for i, (anchor, label, v) in enumerate(kept):
        if anchor % 10:
            continue
        scored = sorted((-product(v, w), k, other == label) for j, (k, other, w) in enumerate(kept) if j != i)
        for s, positive, _ in [x for x in scored if x[2]][:5]:
            found = [x for x in scored if not x[2] and 30 * -s <= 100 * -x[0] <= 90 * -s][:10]
            out += [(anchor, positive, r + 1, k, -s, -t) for r, (t, k, _) in enumerate(found)]
    return Counter(out)


@pytest.mark.parametrize("small", [False, True])
def test_negatives(spark, monkeypatch, small):
    if small:
        for name, value in (("PART", 16), ("ASKED", 4), ("AT_ONCE", 3), ("WAVES", (1, 2, 5, 512))):
            monkeypatch.setattr(negatives, name, value)
    rows = table(1)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = negatives.mine(df, F.col("id") % 10 == 0, lists=8).collect()
    want = plain_negatives(rows)
    assert Counter(map(tuple, got)) == want and len(want) > 500


def test_negatives_of_nothing(spark):
    assert negatives.mine(spark.createDataFrame([], SCHEMA), F.col("id") % 10 == 0).collect() == []
    one = spark.createDataFrame([(0, 1, [1.0], "x", 1, 2), (1, 2, [1.0], "x", 1, 2)], SCHEMA)
    assert negatives.mine(one, F.col("id") % 10 == 0).collect() == []
    none = spark.createDataFrame([(0, None, [1.0], "x", 1, 2), (1, 2, None, "x", 1, 2)], SCHEMA)
    assert negatives.mine(none, F.col("id") % 10 == 0).collect() == []


def test_lists_that_cannot_help_are_skipped(spark):
    """Far clusters are neither met for positives nor, outside the window, for negatives; bounds hold for every member."""
    r = np.random.default_rng(3)
    centers = 100 * np.eye(8)
    x = np.rint(centers[r.integers(0, 8, 800)] * 8 + r.normal(0, 2, (800, 8))).astype(float)
    lists = negatives.Lists(negatives.fit(x, 8))
    near, distance = negatives.nearest(x, lists.centers)
    for i in range(8):
        lists.sizes[i], lists.radii[i] = (near == i).sum(), distance[near == i].max()
    low, high = lists.bounds(x, np.sqrt((x**2).sum(1)))
    scores = x @ x.T
    assert (scores <= high[:, near]).all() and (scores >= low[:, near]).all()
    assert (high < 0.5 * (x**2).sum(1)[:, None]).sum(1).min() >= 6  # of eight


def plain_topk(rows, k):
    kept = whole([(i, k_, v) for i, k_, v, *_ in rows], 1024)
    out = []
    for i, (query, _, v) in enumerate(kept):
        if query % 10 == 0:
            scored = sorted((-product(v, w), k_) for j, (k_, _, w) in enumerate(kept) if j != i)[:k]
            out += [(query, r + 1, k_, -s) for r, (s, k_) in enumerate(scored)]
    return Counter(out)


@pytest.mark.parametrize(("spread", "small"), [(1.0, False), (1.0, True), (0.01, True)])
def test_topk(spark, monkeypatch, spread, small):
    if small:
        for name, value in (("LEAST_ROWS", 8), ("BLOCK_BYTES", 400), ("CHUNK", 5), ("WAVE", 3)):
            monkeypatch.setattr(topk, name, value)
    rows = table(2, 300, spread=spread)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = topk.top_k(df, F.col("id") % 10 == 0, 4).collect()
    want = plain_topk(rows, 4)
    assert Counter(map(tuple, got)) == want and len(want) > 100


def test_topk_of_few(spark):
    assert topk.top_k(spark.createDataFrame([], SCHEMA), F.col("id") % 10 == 0).collect() == []
    rows = [(0, 1, [1.0, 2.0], "x", 1, 2), (1, 1, [-1.0, 0.5], "x", 1, 2), (2, 1, [], "x", 1, 2)]
    got = topk.top_k(spark.createDataFrame(rows, SCHEMA), F.col("id") == 0).collect()
    assert [tuple(r) for r in sorted(got)] == [(0, 1, 1, 0), (0, 2, 2, 0)]


def test_pairs_are_left_early():
    """Residual bounds leave nearly all pairs of vectors whose lengths fall; what is found is exact."""
    r = np.random.default_rng(4)
    x = np.rint(r.normal(0, 1, (4000, 32)) * 200 * np.exp(-np.arange(4000) / 400)[:, None])
    x = x[np.argsort(-(x**2).sum(1), kind="stable")]
    met = []
    real = topk.products
    topk.products = lambda a, b: met.append(len(a) * len(b)) or real(a, b)
    try:
        ids = np.arange(4000)
        unit, ident, score = topk.visit(x[:50], x, np.full(50, vectors.NONE), ids[:50], ids, ids, np.linalg.svd(x[:500])[2].T, 10)
    finally:
        topk.products = real
    assert sum(met) < 50 * 1600
    scores = (x[:50] @ x.T).astype(int)
    np.fill_diagonal(scores[:, :50], -(10**9))
    for q in range(50):
        want = sorted(zip(-scores[q], ids, strict=True))[:10]
        assert sorted(zip(-score[unit == q], ident[unit == q], strict=True)) == want


def test_exact_beyond_doubles():
    a = np.array([[2.0**27, 3.0], [1.0, 2.0**27 + 1]])
    assert vectors.products(a, a).tolist() == [[2**54 + 9, 2**27 + 3 * (2**27 + 1)], [2**27 + 3 * (2**27 + 1), 1 + (2**27 + 1) ** 2]]
