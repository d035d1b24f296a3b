"""Gates, tilted weights, text facts and models, each by a plain version."""

import datetime as dt
import math
import random
import unicodedata
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import decisions, models, text
from tidemark.sources.panel import save_artifacts

DAY = dt.date(2021, 1, 4)


def level_shares(capacity, total, wish):
    """Shares at the water level at which they add up to the total, by bisection."""
    total = min(total, sum(capacity))
    liked = [w > 0 for w in wish]
    if total > sum(c for c, on in zip(capacity, liked, strict=True) if on):  # the liked are full
        rest = total - sum(c for c, on in zip(capacity, liked, strict=True) if on)
        others = level_shares([0 if on else c for c, on in zip(capacity, liked, strict=True)], rest, [1.0] * len(wish)) if not all(liked) else [0] * len(wish)
        return [c if on else o for c, on, o in zip(capacity, liked, others, strict=True)]
    low, high = 0.0, max([c / w for c, w in zip(capacity, wish, strict=True) if w > 0], default=0.0)
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(c, level * w) for c, w in zip(capacity, wish, strict=True)) < total else (low, level)
    return [min(c, high * w) for c, w in zip(capacity, wish, strict=True)]


def test_allocate(spark):
    r = random.Random(3)
    rows, k = [], 0
    for g in range(60):
        total = r.choice([0.0, 0.1, 1.0, 5.0, 50.0])
        for _ in range(r.choice([1, 2, 5, 40])):
            rows.append((g, k, r.choice([0.0, 0.05, 0.5, r.random()]), total, r.choice([0.0, 0.0, 1.0, r.random() * 10 ** r.randrange(-3, 4)])))
            k += 1
    # Fifty that fill one after another, far more than any fixed number of rounds.
    rows += [(99, k + i, 0.01, 0.45, 2.0**-i) for i in range(50)]
    df = spark.createDataFrame(rows, "g int, k int, room double, total double, wish double")
    got = {x.k: x.share for x in decisions.allocate(df, ["g"], "room", "total", "wish", "share").collect()}
    for g in {x[0] for x in rows}:
        own = [x for x in rows if x[0] == g]
        shares = [got[x[1]] for x in own]
        assert all(0 <= s <= x[2] + 1e-12 for s, x in zip(shares, own, strict=True))
        assert sum(shares) == pytest.approx(min(own[0][3], sum(x[2] for x in own)), abs=1e-9)
        assert shares == pytest.approx(level_shares([x[2] for x in own], own[0][3], [x[4] for x in own]), abs=1e-9)
    none = spark.createDataFrame([(1, 1, None, 1.0, 2.0), (1, 2, 0.5, 1.0, None), (2, 3, 0.5, None, 1.0)], "g int, k int, room double, total double, wish double")
    assert {x.k: x.share for x in decisions.allocate(none, ["g"], "room", "total", "wish", "share").collect()} == {1: 0.0, 2: 0.5, 3: 0.0}


@pytest.mark.parametrize("tracking", [0.06, 0.0005])
def test_benchmark_relative(spark, tracking):
    """Weights add up to one, sectors keep theirs, no stock or sector takes more than its budget, the error is held, and the best are tilted to."""
    r = random.Random(2)
    n, budget, stock = 12, 0.15, 0.0075
    days = {DAY + dt.timedelta(k): [(e, "abcd"[r.randrange(4)], r.choice([None, 0.0, -1.0, *(r.random() * 9 for _ in range(6))]), r.choice([None, *(round(r.random(), 3) for _ in range(3))]), r.choice([None, 0.0, *(0.01 + r.random() / 20 for _ in range(5))])) for e in range(r.choice([3, 40, 60]))] for k in range(6)}
    df = spark.createDataFrame([(d, *x, 0.9) for d, own in days.items() for x in own], "date date, entity int, sector string, benchmark_weight double, score double, volatility double, confidence double")
    got = decisions.benchmark_relative(df, n, budget, stock, tracking).collect()
    for d, own in days.items():
        base = {e: max(w or 0.0, 0.0) for e, _, w, *_ in own}
        whole = sum(base.values())
        mine = {x.entity: x for x in got if x.date == d}
        if not whole:
            assert not mine
            continue
        base = {e: w / whole for e, w in base.items()}
        info = {e: (s, c, v) for e, s, _, c, v in own}
        assert set(mine) == set(base) and sum(x.weight for x in mine.values()) == pytest.approx(1)
        assert all(abs(x.tilt) <= stock + 1e-12 and x.weight >= 0 for x in mine.values())
        assert math.sqrt(sum((x.tilt * (0.02 if info[e][2] is None else info[e][2])) ** 2 for e, x in mine.items()) * 252) <= tracking + 1e-12
        for s in "abcd":
            sector = [e for e in base if info[e][0] == s]
            share = sum(base[e] for e in sector)
            tilts = {e: mine[e].tilt for e in sector}
            assert sum(tilts.values()) == pytest.approx(0, abs=1e-12)
            assert sum(t for t in tilts.values() if t > 0) <= budget * 0.9 * share + 1e-12
            up, down = [e for e in sector if tilts[e] > 1e-12], [e for e in sector if tilts[e] < -1e-12]
            assert all(info[e][1] is not None for e in up) and len(up) <= max(1, round(n * share))
            if up:  # nobody outside the choice scores above it
                assert min(info[e][1] for e in up) >= max((info[e][1] for e in down if info[e][1] is not None), default=0)


def test_gates(spark):
    with pytest.raises(ValueError, match="label_end"):
        decisions.assert_features_safe(spark.range(1), ["ret_4", "label_end"])
    assert decisions.assert_features_safe(spark.range(3), ["ret_4", "id"]).count() == 3
    df = spark.createDataFrame([(1.0, 3), (2.0, 5), (None, 9)], "v double, age int")
    gate = decisions.staleness(df, "v", "age", 0.6, 9)
    assert gate.first().passed and decisions.require(gate).count() == 1
    with pytest.raises(Exception, match="gate not passed"):
        decisions.require(decisions.staleness(df, "v", "age", 0.7, 9)).collect()
    assert not decisions.staleness(df.limit(0), "v", "age").first().passed
    full = spark.createDataFrame([tuple([True] * len(decisions.CERTIFIED_BY)), (None, *[True] * (len(decisions.CERTIFIED_BY) - 1))], ", ".join(f"{c} boolean" for c in decisions.CERTIFIED_BY))
    a, b = decisions.certify(full).collect()
    assert a.production_prediction_ready and a.reasons == [] and not a.execution_authorized and a.future_confirmation_status == "COLLECTING"
    assert not b.production_prediction_ready and b.reasons == [decisions.CERTIFIED_BY[0]]
    assert decisions.certify(full.drop("stability_passed")).first().reasons == ["stability_passed"]


def test_clean_title(spark):
    titles = ["<em>A</em> &amp; B", "<>x<>", " 　全角　Ａ１ ", "a b c\n", "&lt;b&gt; <i", None, "", "<a\nhref='x'>link</a>&nbsp;&#233;", "ﬁ ①"]
    want = ["A&B", "x", "全角A1", "abc", "<b><i", None, "", "linké", "fi1"]
    got = spark.createDataFrame(list(enumerate(titles)), "i int, t string").select("i", text.clean_title(F.col("t")).alias("t")).orderBy("i").collect()
    assert [x.t for x in got] == want


def test_unit_mentions(spark):
    body = "营收１,２３４.５万元，比−3.25 %；亏损-12亿元, v1.2.3元? 3,45元 ￥7元" + "x" * 100 + "0.5元"
    rows = text.unit_mentions(spark.createDataFrame([(1, body), (2, None), (3, ""), (4, "12 万")], "k int, t string"), "k", "t").orderBy("place").collect()
    flat = unicodedata.normalize("NFKC", body).replace("−", "-")
    assert {x.k for x in rows} == {1} and all(flat[x.start : x.end] == x.text for x in rows)
    assert [(x.value, x.unit, x.kind) for x in rows] == [(Decimal("12345000"), "万元", "CNY"), (Decimal("-0.0325"), "%", "ratio"), (Decimal("-1200000000"), "亿元", "CNY"), (Decimal("7"), "元", "CNY"), (Decimal("0.5"), "元", "CNY")]
    assert rows[-1].context == flat[max(0, rows[-1].start - 70) : rows[-1].end + 70]


@pytest.mark.parametrize("digits", [20, 21, 24, 28, 29, 30, 31, 60, 400])
def test_unit_mentions_of_many_digits(spark, digits):
    number = "9" * digits
    rows = text.unit_mentions(spark.createDataFrame([(1, f"{number}元 {number}.{number}元 {number}亿元 -{number}%")], "k int, t string"), "k", "t").orderBy("place").collect()
    fits = lambda v: None if abs(v) >= 10**30 else v
    whole = int(number)
    assert len(rows) == 4 and rows[0].value == fits(Decimal(whole)) and rows[2].value == fits(Decimal(whole * 10**8))
    assert rows[3].value == (None if digits > 30 else Decimal(f"-{whole // 100}.{whole % 100:02d}"))
    assert rows[1].value == (None if digits >= 30 else Decimal(whole + 1))  # nines after the point round up


def test_allowed_url(spark):
    good = ["https://a.org/x/12", "https://w.a.org:443/x/1?q=2"]
    bad = ["http://a.org/x/12", "https://a.org:8443/x/1", "https://u@a.org/x/1", "https://a.org/x/1#f", "https://ba.org/x/1", "https://a.org/x/", "https://a.org/x/1/y", "not a url", "", None]
    df = spark.createDataFrame([(u,) for u in good + bad], "u string")
    got = [bool(x[0]) for x in df.select(F.coalesce(text.allowed_url(F.col("u"), {"a.org": r"/x/\d+"}), F.lit(False))).collect()]
    assert got == [True] * len(good) + [False] * len(bad)


def test_ridges(spark):
    r = np.random.default_rng(3)
    rows = pd.DataFrame(r.normal(size=(200, 3)), columns=["a", "b", "y"]).assign(k=r.choice(["x", "z"], 200), d=r.integers(0, 30, 200))
    df = spark.createDataFrame([(float(a), float(b), float(y), str(k), int(d)) for a, b, y, k, d in rows.itertuples(index=False)], "a double, b double, y double, k string, d int")
    by = models.ridge_by(df, ["a", "b"], "y", 2.0, "k", date="d")
    for k, g in rows.groupby("k"):
        x = (g[["a", "b"]] - g[["a", "b"]].mean()) / g[["a", "b"]].std(ddof=0)
        coef = np.linalg.solve(x.T @ x + 2 * np.eye(2), x.T @ g.y)
        m, n, dates = by[k]
        assert m.coef == pytest.approx(tuple(coef)) and m.intercept == pytest.approx(g.y.mean()) and (n, dates) == (len(g), g.d.nunique())
    wide = models.ridge_arrays(df.repartition(3).select(F.array("a", "b").alias("x"), "y"), "x", "y", 2.0)
    whole = models.ridge(df, ["a", "b"], "y", 2.0)
    assert wide.coef == pytest.approx(whole.coef) and wide.intercept == pytest.approx(whole.intercept)


def test_artifacts(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    for kind in ("csv", "parquet", "json"):
        path = save_artifacts(str(tmp_path / kind), {"t": df}, kind)["t"]
        read = spark.read.schema(df.schema).format(kind).option("header", True).load(path)
        assert sorted(map(tuple, read.collect())) == [(1, "a"), (2, None)]
        with pytest.raises(Exception, match="exists"):
            save_artifacts(str(tmp_path / kind), {"t": df}, kind)
