"""Regimes, timing and confidence again row by row."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import gates

DAY = dt.date(2021, 1, 4)


def test_regime(spark):
    rows = [(1, 0.05, 0.1, True), (1, 0.03, None, True), (1, -9.0, -1.0, False), (1, 0.0, 0.2, True), (2, -0.1, -0.1, True), (2, -0.1, -0.1, None), (3, 0.1, 0.1, False), (4, 0.05, -0.1, True)]
    got = {r.date: (r.momentum, r.breadth, r.regime) for r in gates.market_regime(spark.createDataFrame(rows, "date int, m double, r double, e boolean"), "m", "r", F.col("e")).collect()}
    assert got == {1: (pytest.approx(0.08 / 3), pytest.approx(2 / 3), "risk_on"), 2: (-0.1, 0.0, "risk_off"), 3: (None, None, "neutral"), 4: (0.05, 0.0, "neutral")}


def test_timing(spark):
    r = random.Random(1)
    days = [DAY + dt.timedelta(i) for i in range(40)]
    rows = [(e, d, r.choice([None, float("nan"), 0.0]) if r.random() < 0.02 else 10 + r.random(), r.choice([None, -1.0, 1.0, 2.0, 3.0]), r.choice([True, True, True, None, False])) for e in range(12) for d in days if r.random() < 0.97]
    df = spark.createDataFrame(rows, "entity int, date date, close double, benchmark_weight double, in_universe boolean")
    sessions = spark.createDataFrame([(d, i + 1) for i, d in enumerate(days)], "date date, session int")
    got = {x.date: x for x in gates.market_timing(df, sessions, 5, 0.8).collect()}
    at = {(e, d): (c, max(w or 0.0, 0.0) if u else 0.0) for e, d, c, w, u in rows}
    whole = {d: sum(w for (_, q), (_, w) in at.items() if q == d) for d in days}
    returns = []
    for i, d in enumerate(days):
        num = covered = 0.0
        for e in range(12):
            if i and (e, d) in at and (e, days[i - 1]) in at:
                c, (b, w) = at[e, d][0], at[e, days[i - 1]]
                if b is not None and b > 0 and c is not None and math.isfinite(c) and math.isfinite(b):
                    share = w / whole[days[i - 1]]
                    num, covered = num + (c / b - 1) * share, covered + share
        returns.append(num / covered if covered >= 0.8 else None)
        assert got[d].covered_weight == pytest.approx(covered, abs=1e-12) and got[d].market_return == (None if returns[-1] is None else pytest.approx(returns[-1], abs=1e-12))
        last = returns[max(0, i - 4) : i + 1]
        m = math.prod(1 + x for x in last) - 1 if len(last) == 5 and None not in last else None
        regime = None if m is None else "bull" if m > 0.02 else "bear" if m < -0.02 else "neutral"
        assert got[d].market_momentum == (None if m is None else pytest.approx(m, abs=1e-12)) and got[d].regime == regime
        assert got[d].weight == {None: None, "bull": 0.5, "neutral": 0.65, "bear": 0.8}[regime]
    assert {x.regime for x in got.values()} >= {None, "bull", "bear"}


def test_confidence_and_lower_bound(spark):
    cases = {"all": ([1, 1], [2, 2], 1.0), "one": ([1, 3], [2, -1], 0.5), "some": ([1, -3], [2, 1], 0.25), "none": ([-1, -1], [-2, -1], 0.0), "gap": ([1, None], [1, 1], 0.0), "zero": ([0, 0], [0, 0], 0.0)}
    rows = [(k, 2000 + i, *map(lambda v: None if v is None else float(v), x)) for k, (a, b, _) in cases.items() for i, x in enumerate(zip(a, b, strict=True))]
    rows += [("short", 2000, 1.0, 1.0)] + [("long", 2000 + i, 1.0, 1.0) for i in range(3)]
    got = {r.k: r.confidence for r in gates.confidence_from_years(spark.createDataFrame(rows, "k string, y int, a double, b double"), "k", "y", ["a", "b"]).collect()}
    assert got == {k: c for k, (_, _, c) in cases.items()} | {"short": None, "long": None}
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, 4.0, None)], "v double")
    assert df.agg(gates.lower_bound("v", 2.0).alias("b")).first().b == pytest.approx(7 / 3 - 2 * math.sqrt(7 / 3) / math.sqrt(3))
    assert df.limit(1).agg(gates.lower_bound("v", 2.0).alias("b")).first().b is None


def test_gates_by_hand(spark):
    """A score that orders its dates, groups and periods passes; its opposite fails; nothing known fails."""
    r = random.Random(2)
    rows = []
    for y in range(5):
        for k in range(4):
            for e in range(24):
                s = r.random()
                rows.append((dt.date(2015 + y, 1 + k, 5), e, "ab"[e % 2], s, s + r.gauss(0, 0.05), s * 2 + r.gauss(0, 0.05)))
    df = spark.createDataFrame(rows, "date date, entity int, g string, s double, near double, far double")
    say = lambda x: {v.measure: (v.value, v.passed) for v in x.collect()}
    good = say(gates.ranking_gate(df, "s", "near", "far", "g", "a"))
    assert all(p for _, p in good.values()) and good["positive_near_years"] == (5.0, True) and good["mean_near_ic"][0] > 0.9
    bad = say(gates.ranking_gate(df.withColumn("s", -F.col("s")), "s", "near", "far", "g", "a"))
    assert not any(p for _, p in bad.values())
    picked = say(gates.selection_gate(df, "s", "near", "far", "g", "entity"))
    assert all(p for _, p in picked.values())
    spreads, lifts = [], []
    for d in sorted({x[0] for x in rows}):
        cells = []
        for g in "ab":
            own = sorted((x for x in rows if x[0] == d and x[2] == g), key=lambda x: (x[3], x[1]))
            top = [x for i, x in enumerate(own) if round((i + 1) / len(own), 9) > 0.8]
            rest = [x for x in own if x not in top]
            truth = sorted(own, key=lambda x: (x[4], x[1]))[-len(top) :]
            cells.append((sum(x[4] for x in top) / len(top) - sum(x[4] for x in rest) / len(rest), sum(x in truth for x in top) / len(top) - 0.2))
        spreads.append(sum(c[0] for c in cells) / 2)
        lifts.append(sum(c[1] for c in cells) / 2)
    assert picked["mean_near_spread"][0] == pytest.approx(sum(spreads) / len(spreads)) and picked["precision_lift"][0] == pytest.approx(sum(lifts) / len(lifts))
    assert not any(p for _, p in say(gates.selection_gate(df.where("entity < 12"), "s", "near", "far", "g", "entity", least=13)).values())
    periods = [(dt.date(2015 + i // 4, 1 + i % 4, 1), 0.02 if i % 3 else -0.01, 0.005, 0.3, 0.001) for i in range(20)]
    curve = spark.createDataFrame(periods, "date date, period_return double, benchmark_return double, turnover double, cost double")
    got = say(gates.conversion_gate(curve, curve, years=3))
    wealth = peak = 1.0
    worst = 0.0
    for i, (_, p, b, *_) in enumerate(periods):
        wealth *= (1 + p) / (1 + b)
        peak = max(peak, wealth) if i else wealth
        worst = min(worst, wealth / peak - 1)
    assert all(p for _, p in got.values()) and got["active_max_drawdown"][0] == pytest.approx(worst)
    assert got["excess_return"][0] == pytest.approx(math.prod(1 + x[1] for x in periods) - math.prod(1 + x[2] for x in periods))
    dear = say(gates.conversion_gate(curve.withColumn("cost", F.col("cost") * 2), curve, floor=0.0))
    assert not dear["average_cost"][1] and dear["average_turnover"][1] and not dear["active_max_drawdown"][1]
