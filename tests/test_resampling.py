"""Bootstrap and permutation again in plain Python."""

import hashlib
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluate, resampling
from tidemark.sources import stages
from tidemark.sources.stages import numbered, running


def draw(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:13], 16)


def test_paired_bootstrap(spark):
    r = random.Random(4)
    rows = [(k, i, r.choice([None, r.gauss(0, 1)]) if r.random() < 0.2 else r.gauss(0.1, 1), r.gauss(0, 1)) for k, n in (("a", 57), ("b", 40), ("c", 19), ("d", 4)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, i int, x double, y double").repartition(3)
    block, reps = 10, 60
    got = {x.k: x for x in resampling.paired_bootstrap(df, "k", "i", "x", "y", block, reps, 9).collect()}
    again = {x.k: x for x in resampling.paired_bootstrap(df.orderBy(F.desc("i")), "k", "i", "x", "y", block, reps, 9).collect()}
    assert got == again and set(got) == set("abcd")
    for k, x in got.items():
        delta = [round(a - b, 12) for q, i, a, b in sorted(rows, key=lambda z: z[1]) if q == k and a is not None]
        n = len(delta)
        assert x.samples == n and x.mean_delta == pytest.approx(np.mean(delta), abs=1e-10)
        if n < 2 * block:
            assert x.ci_lower is None and x.ci_upper is None
            continue
        means = []
        for rep in range(reps):
            sample = [v for j in range(math.ceil(n / block)) for at in [draw(9, k, rep, j) % (n - block + 1)] for v in delta[at : at + block]]
            means.append(np.mean(sample[:n]))
        assert (x.ci_lower, x.ci_upper) == pytest.approx(tuple(np.quantile(means, [0.025, 0.975])), abs=1e-10)
    assert resampling.paired_bootstrap(df.limit(0), "k", "i", "x", "y").collect() == []


def test_permutation_importance(spark):
    r = np.random.default_rng(3)
    x = np.round(r.normal(size=(300, 3)), 2)
    y = np.round(x[:, 0] + 0.3 * x[:, 1] + r.normal(size=300) / 4, 2)
    df = spark.createDataFrame([(int(i % 7), int(i), *map(float, x[i]), float(y[i]) if i % 10 else None) for i in range(300)], "d int, e int, a double, b double, c double, y double")
    names = ["a", "b", "c"]
    score = F.col("a") * 2 + F.col("b") - F.col("c") * 0.1
    got = {v.feature: v.importance for v in resampling.permutation_importance(df, ["d", "e"], names, "y", score, 5).collect()}
    kept = sorted((i % 7, i) for i in range(300) if i % 10)
    z, t = np.array([x[i] for _, i in kept]), np.array([y[i] for _, i in kept])
    rho = lambda m: pd.Series(m[:, 0] * 2 + m[:, 1] - m[:, 2] * 0.1).round(12).rank().corr(pd.Series(t).rank())
    for f, name in enumerate(names):
        order = sorted(range(len(kept)), key=lambda j: (hashlib.md5(f"5:{name}:{kept[j][0]}:{kept[j][1]}".encode()).hexdigest(), kept[j]))
        changed = z.copy()
        changed[:, f] = z[order, f]
        assert got[name] == pytest.approx(rho(z) - rho(changed), abs=1e-9)
    assert got["a"] > got["b"] > abs(got["c"])


def test_permutation_writes_each_row_twice(spark, monkeypatch):
    # Rows used to be written per feature with their hashes, again with their scores, and again per distinct score.
    r = np.random.default_rng(6)
    x = np.round(r.normal(size=(400, 3)), 1)
    df = spark.createDataFrame([(int(i), *map(float, x[i]), float(round(x[i, 0] + r.normal(), 1))) for i in range(400)], "e int, a double, b double, c double, y double")
    made, written = [], stages.written
    for module in (stages, resampling):
        monkeypatch.setattr(module, "written", lambda df, name: made.append(written(df, name)) or made[-1])
    got = resampling.permutation_importance(df, ["e"], ["a", "b", "c"], "y", F.col("a") + F.col("b"), 2)
    assert {v.feature: round(v.importance, 9) for v in got.collect()}["c"] == 0.0
    assert sum(m.count() for m in made) <= 2 * 400 + 4


@pytest.mark.parametrize("few", [3, 1000])
def test_pooled_ic(spark, monkeypatch, few):
    # Ties, a value that most rows have, zeros of either sign, infinities, NaN, and scores that are missing on different rows.
    r = random.Random(7)
    monkeypatch.setattr(evaluate, "FEW_VALUES", few)
    monkeypatch.setattr(stages, "ROWS", 40)
    inf = float("inf")
    draw_s = lambda: r.choice([None, 0.0, -0.0, inf, -inf, float("nan"), *[0.5] * 6, *(round(r.gauss(0, 1), 2) for _ in range(12))])
    rows = [(r.choice([None, *[0.25] * 9, *(round(r.gauss(0, 1), 1) for _ in range(12))]), draw_s(), draw_s(), round(r.gauss(0, 1), 3), 1.0, None) for _ in range(700)]
    df = spark.createDataFrame(rows, "y double, a double, b double, c double, d double, e double").repartition(3)
    got = {x.score: x.rho for x in evaluate.pooled_ic(df, list("abcde"), "y").collect()}
    top = lambda v: (v != v, 0.0 if v != v else v)  # noqa: E731 -- NaN is the highest

    def ranks(values):
        at = sorted(map(top, values))
        low, high = {}, {}
        for i, v in enumerate(at):
            low.setdefault(v, i + 1)
            high[v] = i + 1
        return [(low[top(v)] + high[top(v)]) / 2 for v in values]

    for i in range(3):
        both = [(x[0], x[1 + i]) for x in rows if x[0] is not None and x[1 + i] is not None]
        assert got[i] == pytest.approx(np.corrcoef(ranks([a for a, _ in both]), ranks([b for _, b in both]))[0, 1], abs=1e-9)
    assert got[3] is None and 4 not in got
    assert evaluate.pooled_ic(df.limit(0), ["a"], "y").collect() == []


def test_numbers_and_running_sums_in_ranges(spark):
    r = random.Random(8)
    rows = [("hot" if i % 3 else r.choice(["x", "y", None]), i, r.randrange(100)) for i in range(2000)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, i int, v long").repartition(7)
    got = {x.i: (x.n, x.s) for x in running(numbered(df, ["i"], "n", ["k"]), ["k"], ["i"], F.col("v"), "s").collect()}
    for k in {x[0] for x in rows}:
        total = 0
        for n, (_, i, v) in enumerate(sorted((x for x in rows if x[0] == k), key=lambda x: x[1])):
            assert got[i] == (n, total)
            total += v
    assert numbered(df.limit(0), ["i"]).collect() == []


def test_pooled_ranks(spark):
    r = random.Random(9)
    rows = [(r.choice("ab"), float(r.randrange(20)) if r.random() < 0.7 else 3.0) for _ in range(500)]
    got = evaluate.pooled_ranks(spark.createDataFrame(rows, "k string, v double"), "k", "v", "rank").collect()
    want = pd.DataFrame(rows, columns=["k", "v"])
    want["rank"] = want.groupby("k").v.rank()
    assert sorted(map(tuple, (x.asDict().values() for x in got))) == sorted(map(tuple, want[["k", "v", "rank"]].values.tolist()))
