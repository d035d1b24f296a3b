"""Rules of evaluation, features and labels, each taken again in NumPy or pandas."""

import datetime as dt
import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluate, features, labels, portfolio

DAY = dt.date(2021, 1, 4)


def panel(seed, dates=12, entities=30, gaps=0.1):
    r = np.random.default_rng(seed)
    rows = pd.DataFrame([(DAY + dt.timedelta(7 * i), e) for i in range(dates) for e in range(entities)], columns=["date", "entity"])
    for c in ("x", "y", "size", "momentum"):
        rows[c] = np.round(r.normal(size=len(rows)), 3)
        rows.loc[r.random(len(rows)) < gaps, c] = np.nan
    rows["industry"] = r.choice(["a", "b", "c", None], len(rows))
    return rows


def frame(spark, rows):
    clean = rows.astype(object).where(rows.notna(), None)
    kinds = {"date": "date", "entity": "long", "industry": "string"}
    return spark.createDataFrame([tuple(x) for x in clean.itertuples(index=False)], ", ".join(f"{c} {kinds.get(c, 'double')}" for c in rows.columns))


def by_key(df, column):
    return {(r.date, r.entity): r[column] for r in df.collect()}


def same(got, want, **how):
    assert set(got) == set(want)
    for k, v in want.items():
        v = None if isinstance(v, float) and math.isnan(v) else v
        assert (got[k] is None) == (v is None), (k, got[k], v)
        if v is not None:
            assert got[k] == pytest.approx(v, **({"abs": 1e-9} | how)), k


@pytest.mark.parametrize(("controls", "group"), [(["size"], None), (["size"], "industry"), ([], "industry"), (["size", "momentum", "x"], "industry")])
def test_residuals(spark, controls, group):
    rows = panel(1, 6, 40)
    rows.loc[rows.date == DAY, "y"] = np.where(rows[rows.date == DAY].entity < 12, 1.0, np.nan)  # too few
    rows.loc[rows.date == DAY + dt.timedelta(7), "size"] = 0.5  # no variance
    want = {}
    for day, g in rows.groupby("date"):
        known = g[g.y.notna()]
        for e in g.entity:
            want[day, e] = None
        if len(known) < 20:
            continue
        parts = [np.ones((len(known), 1)), known[controls].fillna(0).to_numpy(float)]
        if group:
            parts.append(pd.get_dummies(known[group].fillna("UNKNOWN"), dtype=float).to_numpy()[:, 1:])
        design = np.column_stack(parts)
        rest = known.y.to_numpy() - design @ np.linalg.lstsq(design, known.y.to_numpy(), rcond=None)[0]
        want |= {(day, e): v for e, v in zip(known.entity, rest, strict=True)}
    same(by_key(evaluate.residualize(frame(spark, rows), "y", controls, ["date"], group), "residual"), want)


def test_winsor_rank(spark):
    rows = panel(2, 5, 25, 0.2)
    rows.loc[(rows.date == DAY) & (rows.entity >= 4), "x"] = np.nan
    want = {}
    for day, g in rows.groupby("date"):
        v = g.x.dropna()
        lo, hi = v.quantile([0.01, 0.99]) if len(v) else (0, 0)
        rank = g.x.clip(lo, hi).rank(pct=True) - 0.5 if len(v) >= 5 else g.x * np.nan
        want |= {(day, e): 0.0 if math.isnan(r) else r for e, r in zip(g.entity, rank, strict=True)}
    same(by_key(features.winsor_rank(frame(spark, rows), "x", ["date"], "r"), "r"), want)


def test_autocorrelation_and_efficiency(spark):
    rows = panel(3, 40, 3, 0.0).sort_values(["entity", "date"])
    g = rows.groupby("entity").x
    lag = g.shift(1)
    roll = lambda s, f: getattr(s.groupby(rows.entity).rolling(8, min_periods=8), f)().reset_index(0, drop=True)
    auto = (roll(rows.x * lag, "mean") - roll(rows.x, "mean") * roll(lag, "mean")) / (roll(rows.x, "std") * roll(lag, "std"))
    eff = roll(rows.x, "sum").abs() / roll(rows.x.abs(), "sum")
    df = features.efficiency(features.autocorrelation(frame(spark, rows), "x", 8, "a"), "x", 8, "e")
    keys = list(zip(rows.date, rows.entity, strict=True))
    same(by_key(df, "a"), dict(zip(keys, auto.reindex(rows.index), strict=True)))
    same(by_key(df, "e"), dict(zip(keys, eff.reindex(rows.index), strict=True)))


def test_expanding_rank(spark):
    rows = panel(4, 150, 3, 0.1)
    rows["x"] = rows.x.round(1)
    rows = rows.sort_values(["entity", "date"])
    want = {}
    for e, g in rows.groupby("entity"):
        for i in range(len(g)):
            want[g.date.iloc[i], e] = g.x.iloc[: i + 1].rank(pct=True).iloc[-1]
    same(by_key(features.expanding_rank(frame(spark, rows), "x", 16), "own_rank"), want)


def test_quantiles(spark):
    r = np.random.default_rng(5)
    rows = pd.DataFrame({"k": r.choice(["a", "b", "c"], 900, p=[0.8, 0.19, 0.01]), "v": np.round(r.normal(size=900), 2)})
    df = spark.createDataFrame([*rows.itertuples(index=False, name=None), ("d", None), ("e", 7.0)], "k string, v double")
    ps = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]
    got = {x.k: x.q for x in evaluate.quantiles(df, "v", ps, "k").collect()}
    want = {k: np.quantile(g.v, ps).tolist() for k, g in rows.groupby("k")} | {"e": [7.0] * 6}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)
    assert evaluate.quantiles(df, "v", ps).first().q == pytest.approx(np.quantile([*rows.v, 7.0], ps))


@pytest.mark.parametrize("case", ["wide", "ties", "constant", "few", "none"])
def test_psi(spark, case):
    r = np.random.default_rng(6)
    before, now = r.normal(size=400), r.normal(0.4, 1.2, 300)
    if case == "ties":
        before, now = np.round(before), np.round(now)
    if case == "constant":
        before = np.ones(50)
    if case == "few":
        before = before[:9]
    if case == "none":
        now = now[:0]
    a, b = (spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double") for x in (before, now))
    rows = evaluate.psi(a, b, "v").orderBy("bin").collect()
    edges = np.unique(np.quantile(before, np.linspace(0, 1, 11)))
    if case in ("few", "none"):
        assert [x.psi_part for x in rows] == [None]
    elif case == "constant":
        assert [x.psi_part for x in rows] == [0.0]
    else:
        edges[0], edges[-1] = -np.inf, np.inf
        p, q = (np.clip(np.histogram(x, edges)[0] / len(x), 1e-6, None) for x in (before, now))
        assert [x.psi_part for x in rows] == pytest.approx(((q - p) * np.log(q / p)).tolist())


def test_hac_and_fdr(spark):
    r = np.random.default_rng(7)
    series = {"long": r.normal(0.2, 1, 90).cumsum() / 9, "short": r.normal(size=19), "flat": np.full(30, 2.0), "zero": np.zeros(25), "down": np.full(20, -1.0)}
    df = spark.createDataFrame([(k, i, float(v)) for k, x in series.items() for i, v in enumerate(x)] + [("long", 999, None)], "k string, i int, v double")
    got = {x.k: (x.hac_t, x.p) for x in evaluate.hac_t(df, "v", "i", "k").collect()}
    u = series["long"] - series["long"].mean()
    n = len(u)
    var = u @ u / n + sum(2 * (1 - k / 6) * (u[k:] @ u[:-k]) / n for k in range(1, 6))
    t = series["long"].mean() / math.sqrt(var / n)
    assert got["long"] == pytest.approx((t, 2 * (1 - NormalDist().cdf(abs(t)))), abs=1e-6)
    assert got["short"] == (0.0, 1.0) and got["flat"] == (math.inf, 0.0) and got["down"] == (-math.inf, 0.0)
    assert got["zero"] == pytest.approx((0.0, 1.0), abs=1e-6)
    ps = [0.01, 0.2, None, 0.03, 1.4, 0.03, -0.1]
    out = {x.i: x.adjusted_p for x in evaluate.bh_fdr(spark.createDataFrame(list(enumerate(ps)), "i int, p double"), "p").collect()}
    q = np.clip([1.0 if p is None else p for p in ps], 0, 1)
    order = np.argsort(q, kind="stable")
    back = np.minimum.accumulate((q[order] * len(q) / np.arange(1, len(q) + 1))[::-1])[::-1].clip(0, 1)
    assert [out[i] for i in order] == pytest.approx(back.tolist())


def test_pr_auc_and_calibration(spark):
    r = np.random.default_rng(8)
    p, y = np.round(r.random(700), 2), r.integers(0, 2, 700)
    p[::50] = 1.0
    df = spark.createDataFrame([(i, float(a), int(b)) for i, (a, b) in enumerate(zip(p, y, strict=True))] + [(900, None, 1), (901, 0.5, None)], "i int, p double, y int")
    s = y[np.argsort(-p, kind="mergesort")]
    want = (np.cumsum(s) / np.arange(1, len(s) + 1))[s == 1].mean()
    assert evaluate.pr_auc(df, "p", "y", "i").first().average_precision == pytest.approx(want)
    rank = pd.Series(p).rank()
    n = y.sum()
    assert evaluate.roc_auc(df, "p", "y").first().auc == pytest.approx((rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n)))
    bins = pd.cut(p, evaluate.CALIBRATION_EDGES, right=False, include_lowest=True)
    table = pd.DataFrame({"p": p, "y": y, "b": bins}).groupby("b", observed=False).agg(n=("y", "size"), mp=("p", "mean"), hr=("y", "mean"))
    rows = evaluate.calibration(df, "p", "y").orderBy("bin").collect()
    assert [x.n for x in rows] == table.n.tolist() and sum(x.n for x in rows) < 700
    assert [x.mean_p for x in rows] == pytest.approx(table.mp.tolist()) and [x.hit_rate for x in rows] == pytest.approx(table.hr.tolist())


def test_nextgen_labels(spark):
    rows = panel(9, 6, 30)
    rows["w"] = np.where(rows.entity % 4 == 0, np.nan, np.where(rows.entity % 7 == 0, -1.0, 2.0 + rows.entity))
    rows.loc[rows.date == DAY, "w"] = np.nan
    df = labels.nextgen(frame(spark, rows), "y", "x", "size", "w")
    w = rows.w.fillna(0).clip(lower=0)
    total, part = w.groupby(rows.date).transform("sum"), (rows.y.fillna(0) * w).groupby(rows.date).transform("sum")
    market = (part / total.replace(0, np.nan)).fillna(rows.y.groupby(rows.date).transform("mean"))
    keys = list(zip(rows.date, rows.entity, strict=True))
    day = rows.date
    same(by_key(df, "beta_residual"), dict(zip(keys, (rows.y - rows.x * market).round(9).groupby(day).rank(pct=True), strict=True)))
    same(by_key(df, "vol_adjusted"), dict(zip(keys, (rows.y / rows["size"].abs().clip(lower=1e-6)).round(9).groupby(day).rank(pct=True), strict=True)))
    low, high = (rows.y.groupby(day).transform(lambda v, q=q: v.quantile(q)) for q in (0.05, 0.95))
    same(by_key(df, "robust_winsor"), dict(zip(keys, rows.y.clip(low, high), strict=True)))


def test_tail_relevance(spark):
    rows = panel(10, 4, 30)
    place = rows.sort_values(["date", "y", "entity"]).groupby("date").y.rank(pct=True, method="first")
    want = pd.Series(0, rows.index)
    for cut, v in ((0.4, 1), (0.6, 2), (0.8, 3), (0.9, 4)):
        want[place.reindex(rows.index) > cut] = v
    same(by_key(labels.tail_relevance(frame(spark, rows), "y", ["date"], "entity"), "relevance"), dict(zip(zip(rows.date, rows.entity, strict=True), want.tolist(), strict=True)))


def test_execution(spark):
    r = np.random.default_rng(11)
    rows = panel(11, 20, 4, 0.0)[["date", "entity"]]
    for c in ("open", "close"):
        rows[c] = np.round(10 * np.exp(r.normal(0, 0.07, len(rows))), 2)
    rows["volume"] = r.choice([0.0, 5.0, 9.0], len(rows))
    rows.loc[r.random(len(rows)) < 0.1, "open"] = np.nan
    h, limit, want = 2, 0.1, {}
    for e, g in rows.groupby("entity"):
        g = g.reset_index(drop=True)
        at = lambda c, i, g=g: g[c].iloc[i] if i < len(g) else (None if c == "date" else math.nan)
        for i in range(len(g)):
            eo, xo, late = at("open", i + 1), at("open", i + h + 1), at("open", i + h + 2)
            up = eo / at("close", i) - 1 >= limit * 0.995
            tradable = not math.isnan(eo) and at("volume", i + 1) > 0 and not up
            normal = not math.isnan(xo) and at("volume", i + h + 1) > 0 and not xo / at("close", i + h) - 1 <= -limit * 0.995
            leave = xo if normal else late
            ret = leave / eo - 1 if tradable and not math.isnan(leave) else None
            late_ok = not normal and not math.isnan(late) and at("volume", i + h + 2) > 0
            want[g.date.iloc[i], e] = (tradable, late_ok, at("date", i + h + 1) if normal else at("date", i + h + 2), ret)
    got = portfolio.execution(frame(spark, rows), h, F.lit(limit)).collect()
    for x in got:
        tradable, late_ok, day, ret = want[x.date, x.entity]
        assert (x.entry_tradable, x.exit_deferred, x.execution_exit_date) == (tradable, late_ok, day)
        assert (x.execution_return is None) == (ret is None) and (ret is None or x.execution_return == pytest.approx(ret))
