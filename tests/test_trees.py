"""Boosted trees against a booster of plain loops over rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import trees

NAMES = ["a", "b", "c"]
SETTINGS = trees.Settings(rounds=4, rate=0.3, depth=3, leaves=5, least=6, l1=0.5, l2=2.0, feature_fraction=0.7, positive_weight=2.0, bins=9, seed=5)


def table(dates=9, size=25, seed=1):
    r = random.Random(seed)
    rows = []
    for d in range(dates):
        for e in range(size if d else 40):
            x = [r.choice([None, float("nan"), *(round(r.gauss(0, 1), 2) for _ in range(12))]) for _ in NAMES]
            known = [0.0 if v is None or math.isnan(v) else v for v in x]
            rows.append((d, e, *x, round(known[0] - 0.5 * abs(known[1]) + r.gauss(0, 0.3), 3) if r.random() < 0.95 else None))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "date int, entity int, a double, b double, c double, y double").repartition(3)


def plain(rows, objective, s):
    """The scores of all rows, by loops: rows are (date, entity, features..., y)."""
    own = [r for r in rows if r[5] is not None]
    miss = lambda v: v is None or math.isnan(v)
    edges = []
    for f in range(3):
        values = [r[2 + f] for r in own if not miss(r[2 + f])]
        edges.append(sorted(set(np.quantile(values, [k / (s.bins - 1) for k in range(1, s.bins - 1)]).tolist())))
    code = lambda r: [0 if miss(r[2 + f]) else 1 + sum(e < r[2 + f] for e in edges[f]) for f in range(3)]
    x, y = [code(r) for r in own], [r[5] for r in own]
    if objective == "l1":
        base = float(np.median(y))
    elif objective == "binary":
        w = s.positive_weight * np.mean(y)
        base = math.log(w / (1 - np.mean(y)))
    else:
        base = 0.0
    score, grown = [base] * len(own), []
    rng = np.random.default_rng(s.seed)
    soft = lambda g: math.copysign(max(abs(g) - s.l1, 0), g)
    worth = lambda g, h: soft(g) ** 2 / (h + s.l2)
    for _ in range(s.rounds):
        usable = set(rng.permutation(3)[: max(1, round(s.feature_fraction * 3))].tolist())
        g, h = gradients(own, y, score, objective, s)
        splits, frontier, leaves = {}, {0: list(range(len(own)))}, 1
        members = dict(frontier)
        for _ in range(s.depth):
            found = []
            for node, rs in sorted(frontier.items()):
                best = None
                for f in sorted(usable):
                    for b in range(s.bins):
                        left, right = [i for i in rs if x[i][f] <= b], [i for i in rs if x[i][f] > b]
                        if min(len(left), len(right)) < s.least:
                            continue
                        t = lambda q: worth(sum(g[i] for i in q), sum(h[i] for i in q))
                        gain = round(t(left) + t(right) - t(rs), 9)
                        if gain > 1e-9 and (best is None or gain > best[0]):
                            best = (gain, f, b, left, right)
                if best:
                    found.append((best, node))
            found = sorted(found, key=lambda z: (-z[0][0], z[1]))[: s.leaves - leaves]
            if not found:
                break
            leaves += len(found)
            frontier = {}
            for (_, f, b, left, right), node in found:
                splits[node] = (f, b)
                frontier |= {2 * node + 1: left, 2 * node + 2: right}
            members |= frontier
        values = {}
        for node, rs in members.items():
            if node not in splits:
                values[node] = float(np.median([y[i] - score[i] for i in rs])) if objective == "l1" else -soft(sum(g[i] for i in rs)) / (sum(h[i] for i in rs) + s.l2)
        grown.append((splits, values))
        score = [v + s.rate * leaf(splits, values, c) for v, c in zip(score, x, strict=True)]
    return [base + sum(s.rate * leaf(*t, code(r)) for t in grown) for r in rows]


def leaf(splits, values, code):
    at = 0
    while at in splits:
        at = 2 * at + 1 + (code[splits[at][0]] > splits[at][1])
    return values[at]


def gradients(own, y, score, objective, s):
    unit = lambda v: round(v * 2**20) / 2**20
    if objective == "l1":
        return [unit(np.sign(a - b)) for a, b in zip(score, y, strict=True)], [1.0] * len(y)
    if objective == "binary":
        p = [1 / (1 + math.exp(-v)) for v in score]
        w = [s.positive_weight if v else 1.0 for v in y]
        return [unit(w_ * (p_ - v)) for w_, p_, v in zip(w, p, y, strict=True)], [unit(w_ * p_ * (1 - p_)) for w_, p_ in zip(w, p, strict=True)]
    g, h = [0.0] * len(y), [0.0] * len(y)
    for d in {r[0] for r in own}:
        mine = sorted((i for i, r in enumerate(own) if r[0] == d), key=lambda i: (-round(score[i], 9), own[i][1]))
        ideal = sum((2**v - 1) / math.log2(k + 2) for k, v in enumerate(sorted((y[i] for i in mine), reverse=True)[: trees.TOP]))
        for m, i in enumerate(mine[: trees.TOP]):
            for n, j in enumerate(mine):
                if n <= m or y[i] == y[j] or not ideal:
                    continue
                change = abs(2 ** y[i] - 2 ** y[j]) * abs(1 / math.log2(m + 2) - 1 / math.log2(n + 2)) / ideal
                up, down = (i, j) if y[i] > y[j] else (j, i)
                p = 1 / (1 + math.exp(score[up] - score[down]))
                g[up] -= unit(p * change)
                g[down] += unit(p * change)
                h[i] += unit(p * (1 - p) * change)
                h[j] += unit(p * (1 - p) * change)
    return g, h


@pytest.mark.parametrize("objective", ["l1", "binary", "lambdarank"])
def test_against_plain_loops(spark, objective):
    rows = table()
    df = frame(spark, rows)
    if objective == "binary":
        rows = [(*r[:5], None if r[5] is None else float(r[5] > 0)) for r in rows]
        df = frame(spark, rows)
    elif objective == "lambdarank":
        df = trees.relevance(df, "y", ["date"], "entity").withColumn("y", F.col("relevance").cast("double"))
        level = {(r.date, r.entity): r.y for r in df.collect()}
        for d in {r[0] for r in rows}:
            mine = sorted((r for r in rows if r[0] == d and r[5] is not None), key=lambda r: (r[5], r[1]))
            assert all(level[d, r[1]] == min(5, max(1, math.ceil(round((k + 1) / len(mine) * 5, 9)))) - 1 for k, r in enumerate(mine))
        rows = [(*r[:5], level[r[0], r[1]]) for r in rows]
    model = trees.fit(df, NAMES, "y", objective, SETTINGS, "date", "entity")
    got = {(r.date, r.entity): r.s for r in df.select("date", "entity", model.column().alias("s")).collect()}
    want = plain(rows, objective, SETTINGS)
    assert any(t.feature[0] >= 0 for t in model.trees)
    for r, w in zip(rows, want, strict=True):
        assert got[r[0], r[1]] == pytest.approx(w, abs=1e-6)


def test_pairs_are_taken_as_rows_are_ranked(spark, monkeypatch):
    # Every pair used to be an element of a row that was written and another row that was shuffled, joined back by place.
    rows = [(*r[:5], None if r[5] is None else float(abs(int(r[5] * 10)) % 5)) for r in table(5, 90, 3)]
    made, written = [], trees.written
    monkeypatch.setattr(trees, "written", lambda df, name: made.append((name, written(df, name))) or made[-1][1])
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, 7)  # a date's top rows lie in several batches
    try:
        trees.fit(frame(spark, rows), NAMES, "y", "lambdarank", SETTINGS, "date", "entity")
    finally:
        spark.conf.set(size, before)
    assert [n for n, _ in made] == ["trees-rows", "trees-state", *(f"trees-state-{r}" for r in range(SETTINGS.rounds - 1))]
    own = [r for r in rows if r[5] is not None]
    at = {r[:2]: i for i, r in enumerate(own)}
    for _, state in made[1:3]:
        got = state.collect()
        score = {at[x["__date"], x["__key"]]: x.score for x in got}
        g, h = gradients(own, [r[5] for r in own], [score[i] for i in range(len(own))], "lambdarank", SETTINGS)
        assert len(got) == len(own)
        for x in got:
            i = at[x["__date"], x["__key"]]
            assert (x.g / trees.UNIT, x.h / trees.UNIT) == pytest.approx((g[i], h[i]), abs=1e-5)


def test_ranking_learns_and_importance(spark):
    r = np.random.default_rng(7)
    x = r.normal(size=(1000, 3))
    y = x[:, 0] - 0.5 * x[:, 1]
    df = spark.createDataFrame([(i // 20, i, *map(float, x[i]), float(y[i])) for i in range(1000)], "date int, entity int, a double, b double, c double, y double")
    ranked = trees.relevance(df, "y", ["date"], "entity")
    model = trees.fit(ranked, NAMES, "relevance", "lambdarank", trees.Settings(rounds=5, rate=0.3, depth=3, leaves=8, least=30, feature_fraction=1.0), "date", "entity")
    got = [v.s for v in df.withColumn("s", model.column()).orderBy("entity").collect()]
    assert np.corrcoef(got, y)[0, 1] > 0.5
    share = model.importance()
    assert sum(share.values()) == pytest.approx(1) and share["a"] > share["c"]


def test_two_stage(spark):
    df = frame(spark, table(6, 20)).withColumn("sector", F.col("entity") % 2)
    model = trees.fit_two_stage(df, NAMES, "y", ["date", "sector"], "entity", SETTINGS)
    rows = model.score(df).collect()
    assert len(rows) == df.count()
    for r in rows:
        assert 0 <= r.probability <= 1 and math.isfinite(r.magnitude)
        assert r.score == pytest.approx(r.probability * min(max(r.magnitude, 0), 0.10))


def test_edge_cases(spark):
    with pytest.raises(ValueError, match="no rows"):
        trees.fit(frame(spark, []), NAMES, "y", "l1", SETTINGS)
    with pytest.raises(ValueError, match="objective"):
        trees.fit(frame(spark, table(2, 5)), NAMES, "y", "huber", SETTINGS)
    one = [(0, 0, None, 1.0, 2.0, 3.0)]
    model = trees.fit(frame(spark, one), NAMES, "y", "l1", SETTINGS)
    assert frame(spark, one).select(model.column().alias("s")).first().s == 3.0
    assert frame(spark, []).select(model.column().alias("s")).collect() == []
