import random
import zlib

import pytest

from tests.conftest import SF
from tests.llm.helpers import docs
from tidemark.llm import sharding


def brute_capacity(sizes, shards):
    def fits(c):
        used, now = 1, 0
        for s in sizes:
            if s > c:
                return False
            if now + s > c:
                used, now = used + 1, 0
            now += s
        return used <= shards

    return next(c for c in range(max(sizes), sum(sizes) + 1) if fits(c))


@pytest.mark.parametrize("singles", [20_000, 3])
def test_minimax_is_exact(spark, monkeypatch, singles):
    monkeypatch.setattr(sharding, "FIRST_BITS", 3)
    monkeypatch.setattr(sharding, "MORE_BITS", 2)
    monkeypatch.setattr(sharding, "SINGLES", singles)
    r = random.Random(singles)
    for n, shards in ((1, 4), (40, 5), (200, 7)):
        groups = sorted((r.randrange(-(2**63), 2**63), r.randrange(1, 60) if r.random() < 0.9 else 300) for _ in range(n))
        sizes = [s for _, s in groups]
        capacity, cuts = sharding.minimax_cuts(spark.createDataFrame(groups, "key long, size long"), shards, max(sizes))
        assert capacity == brute_capacity(sizes, shards)
        assert len(cuts) < shards
        bins = [sum(s for k, s in groups if sum(k > c for c in cuts) == b) for b in range(len(cuts) + 1)]
        assert max(bins) <= capacity


def check(rows, texts, shards):
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    group = {}
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == ((0 if texts[r.doc_id] is None else len(raw)) + 8, zlib.crc32(raw))
        assert group.setdefault(texts[r.doc_id], r.shard) == r.shard
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_awkward(spark):
    texts = dict(enumerate(["", None, None, "é", "hot" * 50] + ["hot" * 50] * 400 + [f"t{i}" * (i % 9) for i in range(300)]))
    rows = sharding.shard(docs(spark, list(texts.values())), 6).collect()
    check(rows, texts, 6)
    hot = {r.shard for r in rows if texts[r.doc_id] == "hot" * 50}
    assert len(hot) == 1 and {texts[r.doc_id] for r in rows if r.shard in hot} == {"hot" * 50}
    assert sharding.shard(docs(spark, [])).count() == 0


def test_whole_table(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sharding.shard(df).collect()
    texts = {r.doc_id: r.text for r in df.collect()}
    check(rows, texts, 24)
    loads = [sum(r.size for r in rows if r.shard == s) for s in range(24)]
    # The groups in the order of their keys; those above an even share are peeled off, and the rest cut by brute force.
    groups = {}
    for r in sharding.sized_rows(df).collect():
        groups[r.key] = groups.get(r.key, 0) + r["size"]
    left, total, peeled = 24, sum(groups.values()), []
    for k in sorted(groups, key=lambda k: (-groups[k], k)):
        if left == 1 or groups[k] * left <= total:
            break
        total, left = total - groups[k], left - 1
        peeled.append(groups[k])
    sizes = [groups[k] for k in sorted(groups)]
    for size in peeled:
        sizes.remove(size)
    low, high = max(sizes), sum(sizes)
    while low < high:
        middle, used, now = (low + high) // 2, 1, 0
        for s in sizes:
            if now + s > middle:
                used, now = used + 1, 0
            now += s
        low, high = (low, middle) if used <= left else (middle + 1, high)
    assert rows[0].capacity == low and max(loads) == max([low, *peeled])


def test_null_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CELL_ROWS", 3)
    df = spark.createDataFrame([(i % 3 or None, f"t{i % 11}", "x") for i in range(200)], "doc_id long, text string, shard string")
    rows = sharding.shard(df, 4).collect()
    assert len(rows) == 200 and sum(r["size"] for r in rows) == sum(8 + len(f"t{i % 11}") for i in range(200))
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
