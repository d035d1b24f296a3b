import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tests.llm.helpers import docs
from tidemark.llm import mixing
from tidemark.llm.queries import MIX_FRACTION, MIX_POWERS, mix_dimensions


def cells(spark):
    rows = [(s, l, t) for s, l, t in [("a", "en", 900), ("a", "fr", 50), ("b", "en", 30), ("b", "fr", 20), ("c", "de", 5)]]
    return spark.createDataFrame(rows, "source string, lang string, tokens long")


def test_both_ways_reach_the_targets(spark):
    c = cells(spark)
    targets = {d: mixing.smoothed_targets(c, d, p) for d, p in (("source", 0.5), ("lang", 0.7))}
    want = {d: {r["value"]: r["share"] for r in t.collect()} for d, t in targets.items()}
    assert all(abs(sum(w.values()) - 1) < 1e-12 for w in want.values())
    for way, sweeps in ((mixing.rake_on_driver, 200), (mixing.rake_by_joins, 6)):
        got, deviation = way(c, targets, sweeps, 1e-7)
        rows = got.collect()
        for d in ("source", "lang"):
            for v, share in want[d].items():
                assert abs(sum(r["weight"] for r in rows if r[d] == v) - share) <= max(deviation, 1e-7) + 1e-12
    # one more sweep in plain Python gives what six sweeps of joins give
    w = {(r["source"], r["lang"]): r["tokens"] for r in c.collect()}
    total = sum(w.values())
    w = {k: v / total for k, v in w.items()}
    for _ in range(6):
        for i, d in enumerate(("source", "lang")):
            now = {v: sum(x for k, x in w.items() if k[i] == v) for v in want[d]}
            w = {k: x * want[d][k[i]] / now[k[i]] for k, x in w.items()}
    assert {(r["source"], r["lang"]): pytest.approx(r["weight"], abs=1e-12) for r in rows} == w


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_sampling(spark, monkeypatch, broadcast):
    monkeypatch.setattr(mixing, "BROADCAST_CELLS", broadcast)
    texts = ["w " * 10] * 3000 + ["x"] * 300 + [None, "", "x " * 4000]
    source = ["a"] * 3000 + ["b"] * 300 + [None, "c", "c"]
    df = docs(spark, texts, source=source)
    out = mixing.sample_probabilities(df, {"source": F.col("source"), "topic": mixing.topic()}, {"source": 0.5, "topic": 1.0}, 0.4)
    rows = out.select("doc_id", "bucket", "mix.*").collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    expected = sum(r.tokens * r.probability for r in rows)
    assert abs(expected / sum(r.tokens for r in rows) - 0.4) < 1e-3
    for s in "ab":
        own = [r for r in rows if r.source == s]
        p = own[0].probability
        assert all(r.probability == p for r in own)
        assert abs(sum(r.sampled for r in own) - p * len(own)) < 4 * (p * (1 - p) * len(own)) ** 0.5 + 1
    again = {r.doc_id: r.sampled for r in out.select("doc_id", "mix.sampled").collect()}
    assert again == {r.doc_id: r.sampled for r in rows}
    assert mixing.sample_probabilities(docs(spark, []), {"source": F.col("source")}, {"source": 0.5}, 0.4).count() == 0


def test_clashing_columns_and_repeated_ids(spark):
    rows = [(i % 5 or None, "word " * (i % 7), "ab"[i % 2], 1, 2, 3) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, mix int, mix_cell int, mix_probability int")
    out = mixing.sample_probabilities(df, {"source": F.col("source")}, {"source": 0.5}, 0.5)
    got = out.collect()
    assert out.columns == df.columns and len(got) == 60 and all((r.mix_cell, r.mix_probability) == (2, 3) for r in got)
    fate = {}
    for r in got:
        assert fate.setdefault((r.doc_id, r.source), r.mix.sampled) == r.mix.sampled


@pytest.mark.parametrize("limit", [50_000, 0])
def test_targets_that_cells_cannot_have(spark, monkeypatch, limit):
    """Made ones give the nearest shares there are, a caller's raise an error."""
    monkeypatch.setattr(mixing, "DRIVER_CELLS", limit)
    df = docs(spark, ["w " * 50, "w"], source=["a", "b"], lang=["x", "y"])
    dims = {"source": F.col("source"), "lang": F.col("lang")}  # both fix the same two cells, to different shares
    rows = mixing.sample_probabilities(df, dims, {"source": 0.1, "lang": 1.0}, 0.5).select("mix.*").collect()
    p, q = 50**0.1 / (50**0.1 + 1), 50 / 51
    share = (p * q) ** 0.5 / ((p * q) ** 0.5 + ((1 - p) * (1 - q)) ** 0.5)  # one weight, as near to both as can be
    ratio = rows[0].probability / rows[1].probability if rows[0].source == "a" else rows[1].probability / rows[0].probability
    if all(r.probability < 1 for r in rows):
        assert ratio == pytest.approx(share / (1 - share) / 50, rel=1e-3)
    assert all(abs(r.source_gap - abs(share - p)) < 1e-4 and abs(r.lang_gap - abs(share - q)) < 1e-4 for r in rows)
    with pytest.raises(ValueError, match="settled"):
        mixing.sample_probabilities(df, dims, {}, 0.5, targets={"source": {"a": 0.3, "b": 0.7}, "lang": {"x": 0.8, "y": 0.2}})
    good = mixing.sample_probabilities(df, dims, {}, 0.01, targets={"source": {"a": 0.8, "b": 0.2}, "lang": {"x": 0.8, "y": 0.2}}).select("mix.*").collect()
    assert all(r.source_gap < 1e-3 and r.lang_gap < 1e-3 for r in good)


def test_query_by_brute_force(spark):
    """The whole query again in plain Python: cells, targets, raking, scale and draws."""
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    rows = mixing.sample_probabilities(df, mix_dimensions(), MIX_POWERS, MIX_FRACTION).collect()
    texts = {r.doc_id: r for r in df.collect()}
    names = list(MIX_POWERS)
    cells = {}
    for r in rows:
        assert r.mix.tokens == len(re.findall(r"\S+", texts[r.doc_id].text or "", re.ASCII))
        assert (r.mix.source, r.mix.lang) == (texts[r.doc_id].source or "", texts[r.doc_id].lang or "")
        key = tuple(r.mix[n] for n in names)
        cells[key] = cells.get(key, 0) + r.mix.tokens
    total = sum(cells.values())
    weight = {k: v / total for k, v in cells.items()}
    share = []
    for i, n in enumerate(names):
        sums = {}
        for k, v in cells.items():
            sums[k[i]] = sums.get(k[i], 0) + v
        whole = sum(v ** MIX_POWERS[n] for v in sums.values())
        share.append({x: v ** MIX_POWERS[n] / whole for x, v in sums.items()})
    for _ in range(400):
        for i in range(len(names)):
            now = {}
            for k, w in weight.items():
                now[k[i]] = now.get(k[i], 0) + w
            weight = {k: w * share[i][k[i]] / now[k[i]] for k, w in weight.items()}
    low, high = 0.0, max(cells[k] / w for k, w in weight.items() if w)
    for _ in range(100):
        s = (low + high) / 2
        low, high = (s, high) if sum(min(v, weight[k] * s) for k, v in cells.items()) < MIX_FRACTION * total else (low, s)
    for r in rows:
        key = tuple(r.mix[n] for n in names)
        want = min(1.0, weight[key] * high / cells[key]) if cells[key] else 1.0
        assert r.mix.probability == pytest.approx(want, abs=1e-4)
        drawn = int(hashlib.md5(f"7:{r.doc_id}".encode()).hexdigest()[:13], 16) / 16**13
        assert r.mix.sampled == (drawn < r.mix.probability)
    assert len({r.mix.topic for r in rows}) > 4
