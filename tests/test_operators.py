"""Operators that SQL doesn't express, by recomputation; sources, sinks and guards."""

import hashlib
import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import expr, market
from tidemark.operators import evaluate, features, joins, models, portfolio, text
from tidemark.sources import evidence, panel

DAY = dt.date(2024, 1, 1)


def sample(n=400, seed=1):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 3)) * [1, 5, 0.1] + [0, 3, 1]
    y = x @ [0.5, -0.2, 2] + r.normal(size=n)
    return x, y


def frame(spark, x, y, **more):
    rows = [(*map(float, a), float(b), *(c[i] for c in more.values())) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, ["a", "b", "c", "y", *more])


def test_ridge_is_the_closed_form(spark):
    x, y = sample()
    m = models.ridge(frame(spark, x, y), ["a", "b", "c"], "y", 7.0)
    z = (x - x.mean(0)) / x.std(0)
    want = np.linalg.solve(z.T @ z + 7 * np.eye(3), z.T @ (y - y.mean()))
    assert np.allclose(m.coef, want, atol=1e-10) and m.intercept == pytest.approx(y.mean())
    got = [r.s for r in frame(spark, x, y).select(m.column().alias("s")).collect()]
    assert np.allclose(got, y.mean() + z @ want)


def test_weighted_ridge(spark):
    x, y = sample(60)
    w = [float(i % 3) for i in range(60)]
    m = models.ridge(frame(spark, x, y, w=w), ["a", "b", "c"], "y", 1.0, "w")
    rep = np.repeat(np.arange(60), np.array(w, int))
    n = models.ridge(frame(spark, x[rep], y[rep]), ["a", "b", "c"], "y", 1.0)
    assert np.allclose(m.coef, n.coef) and m.intercept == pytest.approx(n.intercept)


def test_logistic_gradient_vanishes_and_platt_is_monotone(spark):
    x, y = sample()
    label = (y > y.mean()).astype(float)
    df = frame(spark, x, label)
    m = models.logistic(df, ["a", "b", "c"], "y", 2.0, rounds=25)
    z = (x - x.mean(0)) / x.std(0)
    p = 1 / (1 + np.exp(-(m.intercept + z @ m.coef)))
    assert abs((label - p).sum()) < 1e-6 and np.allclose(z.T @ (label - p) - 2 * np.array(m.coef), 0, atol=1e-6)
    a, _ = models.monotone_platt(df, "b", "y")
    assert a == 0.0 and models.platt(df, "b", "y")[0] < 0 < models.platt(df, "a", "y")[0]


def test_preprocessor_uses_training_rows_only(spark):
    x, y = sample()
    pre = models.fit_preprocessor(frame(spark, x[:200], y[:200]), ["a"])
    lo, hi, mid = np.quantile(x[:200, 0], [0.01, 0.99, 0.5])
    c = np.clip(x[:200, 0], lo, hi)
    got = [r.v for r in frame(spark, x[200:], y[200:]).select(pre.columns()["a"].alias("v")).collect()]
    assert np.allclose(got, (np.clip(x[200:, 0], lo, hi) - c.mean()) / c.std())
    empty = spark.createDataFrame([(None,)], "a double").select(pre.columns()["a"].alias("v")).first().v
    assert empty == pytest.approx((mid - c.mean()) / c.std())


def test_folds_are_purged(spark):
    dates = spark.createDataFrame([(DAY + dt.timedelta(i), i + 1) for i in range(20)], "date date, session int")
    spans = models.folds(dates, "date", 10, 5, 1)
    rows = spark.createDataFrame([(DAY + dt.timedelta(i), DAY + dt.timedelta(i + 3)) for i in range(20)], "date date, label_end date")
    out = models.assign_folds(rows, spans, "date", "label_end").collect()
    tests = {f: {r.date for r in out if r.fold == f and r.role == "test"} for f in (0, 1)}
    assert sorted(d for t in tests.values() for d in t) == [DAY + dt.timedelta(i) for i in range(10, 20)]
    for r in out:
        if r.role == "train":
            assert r.label_end < min(tests[r.fold]) - dt.timedelta(1)


def test_ledger_conserves_value(spark):
    r = random.Random(2)
    price = {e: 10.0 for e in "abcdef"}
    rows = []
    for i in range(30):
        for e in price:
            price[e] *= 1 + r.uniform(-0.05, 0.05)
            rows.append(("s", DAY + dt.timedelta(i), e, r.random(), price[e] if r.random() < 0.9 else None))
    df = spark.createDataFrame(rows, "strategy string, date date, entity string, score double, price double")
    free = portfolio.ledger(df, 3, 0.0).orderBy("date").collect()
    assert free[0].nav == pytest.approx(1.0) and all(x.cash >= -1e-12 for x in free)
    paid = portfolio.ledger(df, 3, 50.0).orderBy("date").collect()
    assert paid[-1].nav < free[-1].nav
    # the value moves only with prices: what is traded changes nothing without costs
    one = df.where("entity = 'a'").withColumn("score", F.lit(1.0)).withColumn("price", F.coalesce("price", F.lit(None).cast("double")))
    got = portfolio.ledger(one, 1, 0.0).orderBy("date").collect()
    marks = [x.price for x in one.orderBy("date").collect()]
    held = next(i for i, p in enumerate(marks) if p)
    last = [p for p in marks if p][-1]
    assert got[-1].nav == pytest.approx(last / marks[held])


def test_regime_hysteresis(spark, monkeypatch):
    """Against the rules taken one after another, in blocks and at once."""
    r = random.Random(3)
    rows = [(k, DAY + dt.timedelta(i), r.choice([None, *(round(-r.random() * 0.16, 3) for _ in range(9))]), r.choice([None, -1.0, 1.0])) for k in "st" for i in range(300)]

    def step(state, d, m):
        d, m = d or 0.0, m or 0.0
        if d <= -0.12:
            return "defensive"
        if state == "defensive":
            return "cautious" if d > -0.08 and m > 0 else state
        if d <= -0.06:
            return "cautious"
        return "full" if state == "cautious" and d > -0.04 and m > 0 else state

    want, state = {}, {"s": "full", "t": "full"}
    for k, day, d, m in rows:
        state[k] = want[k, day] = step(state[k], d, m)
    df = spark.createDataFrame(rows, "k string, date date, d double, m double")
    for steps in (7, 1000):
        monkeypatch.setattr(portfolio, "STEPS", steps)
        got = portfolio.regime_states(df, "k", "date", "d", "m").collect()
        assert {(x.k, x.date): x.state for x in got} == want
        assert all(x.exposure == {"full": 1.0, "cautious": 0.7, "defensive": 0.4}[x.state] for x in got)


def test_sleeves_and_weights(spark):
    dates = spark.createDataFrame([(DAY + dt.timedelta(i), i + 1) for i in range(4)], "date date, session int")
    held = spark.createDataFrame([(DAY + dt.timedelta(i), e, 0.5) for i in range(4) for e in ("ab", "bc")[i % 2]], "date date, entity string, weight double")
    rows = {(r.date, r.entity): r.weight for r in portfolio.sleeves(held, dates, 2).collect()}
    assert rows[DAY + dt.timedelta(1), "b"] == 0.5 and rows[DAY + dt.timedelta(1), "a"] == 0.25


def test_quotas_place_by_place(spark):
    """Against adding and taking back one place at a time."""
    r = random.Random(6)
    cases = {k: ({g: r.choice([1, 1, 2, 3, r.randrange(1, 60)]) for g in "abcdefgh"[: r.randrange(1, 9)]}, r.choice([1, 2, 5, 9, 20, 40])) for k in range(120)}

    def place(counts, n):
        target, total = min(n, sum(counts.values())), sum(counts.values())
        raw = {g: c / total * target for g, c in counts.items()}
        q = {g: min(max(int(round(raw[g], 9)), 1), c) for g, c in counts.items()}
        while sum(q.values()) < target:
            free = sorted(g for g in q if q[g] < counts[g])
            if not free:
                break
            q[max(free, key=lambda g: round(raw[g] - q[g], 9))] += 1
        while sum(q.values()) > target:
            more = sorted(g for g in q if q[g] > 1)
            if not more:
                break
            q[max(more, key=lambda g: round(q[g] - raw[g], 9))] -= 1
        return q

    for n in {n for _, n in cases.values()}:
        rows = [(k, g, c) for k, (counts, m) in cases.items() if m == n for g, c in counts.items()]
        got = {(x.d, x.g): x.quota for x in portfolio.quotas(spark.createDataFrame(rows, "d int, g string, n long"), "d", "g", "n", n).collect()}
        assert got == {(k, g): q for k, (counts, m) in cases.items() if m == n for g, q in place(counts, n).items()}


def test_asof_keeps_the_right_row_whole(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9), (None, 3)], "k string, t int")
    right = spark.createDataFrame([("a", 2, 1, None), ("a", 5, None, "x"), ("b", 10, 7, "y")], "k string, t int, u int, v string")
    got = {(r.k, r.t): r.fact for r in joins.asof_backward(left, right, "k", "t", "t", ["u", "v"]).collect()}
    assert got["a", 5] == (None, "x") and got["a", 1] is None and got["b", 9] is None and got[None, 3] is None


def test_assert_unique_raises(spark):
    df = spark.createDataFrame([(1,), (1,)], "k int")
    with pytest.raises(Exception, match="duplicate key"):
        joins.assert_unique(df, ["k"]).collect()


def test_bucket_edges(spark):
    for q in (3, 5, 10):
        df = spark.createDataFrame([(i + 1, n) for n in (10, 11, 91, 97) for i in range(n)], "r int, n int")
        for r in df.select("r", "n", expr.rank_first_bucket(F.col("r"), F.col("n"), q).alias("b")).collect():
            edges = [1 + (r.n - 1) * k / q for k in range(1, q)]
            assert r.b == 1 + sum(r.r > e for e in edges)


def test_scalars(spark):
    row = spark.createDataFrame([("688001", 1.96, float("nan"), "1234567")], "c string, x double, nan double, long string")
    r = row.select(
        market.board(F.col("c")).alias("b"), expr.normal_cdf(F.col("x")).alias("p"), expr.finite(F.col("nan")).alias("f"), expr.zfill(F.col("long"), 6).alias("z"),
        expr.clip(F.lit(None).cast("double"), 0.0, 1.0).alias("n"),
        market.confidence(F.lit(0.75), {k: F.lit(v) for k, v in {"oos_skill": 1.5, "calibration_quality": 0.5, "regime_consistency": -1.0, "sector_stability": None, "feature_completeness": 1.0}.items()}, F.lit(0.9)).alias("k"),
        market.price_limit(F.lit("300001"), F.lit(None), F.lit("2019-01-01").cast("date")).alias("old"),
    ).first()
    assert (r.b, r.f, r.z, r.n) == ("科创板", None, "1234567", None)
    assert float(r.old) == 0.1 and r.p == pytest.approx(0.9750021, abs=2e-7) and r.k == pytest.approx((0.22 + 0.09 + 0.075 + 0.2) * 0.9)
    codes = {"300001": ("创业板", 0.2, "sz"), "301001": ("创业板", 0.2, "sz"), "688001": ("科创板", 0.2, "sh"), "689001": ("沪市主板", 0.1, "sh"), "430001": ("北交所", 0.3, "sz"), "830001": ("北交所", 0.3, "sz"), "921001": ("北交所", 0.3, "sh"),
             "930001": ("深市主板", 0.1, "sh"), "600001": ("沪市主板", 0.1, "sh"), "510001": ("深市主板", 0.1, "sh"), "000001": ("深市主板", 0.1, "sz")}
    df = spark.createDataFrame([(c,) for c in codes], "c string")
    got = df.select("c", market.board(F.col("c")), market.price_limit(F.col("c"), F.lit("x"), F.lit("2020-08-24").cast("date")).cast("double"), F.substring(market.market_symbol(F.col("c")), 1, 2)).collect()
    assert {x[0]: tuple(x[1:]) for x in got} == codes


def test_correlation_guards(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (None, 3.0)], "a double, b double")
    assert df.agg(expr.correlation("a", "b")).first()[0] is None
    assert evaluate.rank_ic(df.withColumn("k", F.lit(1)), "a", "b", ["k"], 2).first().ic is None


def test_expanding_rank_ties(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([3, 1, 3, None, 2])], "entity int, date int, v int")
    got = [r.own_rank for r in features.expanding_rank(df, "v").orderBy("date").collect()]
    assert got == [1.0, 0.5, 2.5 / 3, None, 0.5]


def test_csv_panels(spark, tmp_path):
    base, daily = tmp_path / "base", tmp_path / "daily"
    for folder, rows in ((base, ["2024-01-02,1,10,11,9,10,5,50", "2024-01-02,1,12,11,9,10,5,50", "bad,2,1,1,1,1,1,1", "2024-01-02,2,-1,1,1,1,1,1"]), (daily, ["2024-01-02,1,20,21,19,20,5,50", "2024-01-03,1,21,21,19,20,5,50"])):
        folder.mkdir()
        (folder / "a.csv").write_text("date,symbol,open,high,low,close,volume,amount\n" + "\n".join(rows) + "\n")
    assert [(r.symbol, r.open) for r in panel.scan_csv(spark, str(base)).collect()] == [("000001", 10.0)]
    got = panel.scan_union(spark, str(base), str(daily)).orderBy("date").collect()
    assert [(r.date.day, r.open) for r in got] == [(2, 20.0), (3, 21.0)]
    assert {r.file.rsplit("/", 1)[1] for r in evidence.latest_file(spark, str(base), "*.csv").collect()} == {"a.csv"}


def test_demo_panel_is_deterministic(spark):
    a, b = (panel.demo_panel(spark, 3, 50).orderBy("symbol", "date").collect() for _ in range(2))
    assert a == b and len(a) == 150 and all(r.high > r.close > r.low > 0 for r in a)


def test_write_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    path = str(tmp_path / "t")
    assert evidence.write_once(df, path) == "created"
    assert evidence.write_once(df.orderBy(F.desc("k")), path) == "identical"
    with pytest.raises(ValueError, match="other content"):
        evidence.write_once(df.where("k = 1"), path)
    with pytest.raises(ValueError, match="other content"):
        evidence.write_once(df.select(F.col("k").cast("long").alias("k"), "v"), path)
    assert evidence.verify_once(spark, path) and evidence.receipt(spark, path)[0] == 2
    df.where("k = 1").write.mode("overwrite").parquet(path)  # damaged afterwards
    assert not evidence.verify_once(spark, path)
    # A writer that stopped between the rows and the receipt.
    half = str(tmp_path / "half")
    df.write.parquet(half)
    with pytest.raises(ValueError, match="other content"):
        evidence.write_once(df.where("k = 2"), half)
    assert evidence.receipt(spark, half) is None
    assert evidence.write_once(df, half) == "identical" and evidence.verify_once(spark, half)
    none = str(tmp_path / "none")
    assert evidence.write_once(df.limit(0), none) == "created" and evidence.write_once(df.limit(0), none) == "identical"
    assert evidence.table_hash(df).first() == evidence.table_hash(df.orderBy(F.desc("k")).repartition(3)).first()
    assert evidence.table_hash(df).first() != evidence.table_hash(df.where("k = 1")).first()


def test_audit_chain(spark, monkeypatch):
    monkeypatch.setattr(evidence, "RANGE", 4)
    df = spark.createDataFrame([(i * 10, f"event {i}") for i in range(1, 31)], "at long, what string").repartition(3)
    log = evidence.link(df, ["at"], ["what"]).cache()
    rows = {r.sequence: r for r in log.collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for i in range(1, 31):
        before = sha(rows[i - 1].body) if i > 1 else "GENESIS"
        assert rows[i].body == f'{{"what":"event {i}"}}' and rows[i].previous_hash == before and rows[i].record_hash == sha(f"{i}|{before}|{rows[i].body}")
    faults = lambda x: {tuple(r) for r in evidence.verify_chain(x).collect()}
    assert faults(log) == set() and faults(log.limit(0)) == set()
    s = F.col("sequence")
    assert faults(log.withColumn("body", F.when(s == 3, "forged").otherwise(F.col("body")))) == {(3, "hash"), (4, "previous_hash")}
    forged = log.withColumn("body", F.when(s == 3, "forged").otherwise(F.col("body"))).withColumn("record_hash", F.when(s == 3, evidence.record_hash()).otherwise(F.col("record_hash")))
    assert faults(forged) == {(4, "previous_hash")}
    assert faults(log.where(s != 3)) == {(4, "missing")} and faults(log.where(s > 2)) == {(3, "missing")}
    assert faults(log.unionByName(log.where(s == 7))) == {(7, "repeated")}
    swapped = log.withColumn("sequence", F.when(s == 5, 6).when(s == 6, 5).otherwise(s))
    assert faults(swapped) == {(5, "hash"), (6, "hash"), (5, "previous_hash"), (6, "previous_hash"), (7, "previous_hash")}
    # Digests of ranges lead from the seal to the range that was changed.
    tree = lambda x: {(r.level, r.place): r.digest for r in evidence.range_digests(x).collect()}
    one, two = tree(log), tree(forged)
    assert {k for k in one if one[k] != two[k]} == {(0, 0), (1, 0), (2, 0)} and max(k for k, _ in one) == 2 and len(one) == 8 + 2 + 1


def test_text(spark):
    df = spark.createDataFrame([(1, "<b>Ａ&amp; b</b> 12.50 x 7"), (2, None)], "k int, t string")
    assert [r.c for r in df.orderBy("k").select(text.clean_title("t").alias("c")).collect()] == ["A&b12.50x7", None]
    assert [(r.place, float(r.value)) for r in text.number_mentions(df, "k", "t").orderBy("place").collect()] == [(0, 12.5), (1, 7.0)]
    page = spark.createDataFrame([("<p>a<script>x<y</script> <b>c</b></p>",)], "h string").select(text.visible_text(F.col("h")).alias("v")).first().v
    assert page == "a c"
    h = text.hashed_counts(spark.createDataFrame([(1, "abab")], "k int, t string"), "k", text.char_ngrams(F.col("t"), 2), 1 << 20).collect()
    assert sum(r.weight**2 for r in h) == pytest.approx(1) and sorted(round(r.weight * math.sqrt(5), 6) for r in h) == [1, 2]


def test_ngram_counts_of_any_length(spark):
    texts = ["abcabcabc", "ab", "", None, "a\nb😀\n" * 80, "".join(chr(97 + i * i % 23) for i in range(401)), "xyzé😀 " * 1500, "q" * 2000, "q" * 2001, "q" * 4002]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    for n in (1, 3, 6):
        want = {k: (len(g), len(set(g))) for k, t in enumerate(texts) if (g := [t[i : i + n] for i in range(len(t or "") - n + 1)])}
        assert {r.k: (r.grams, r.distinct_grams) for r in text.ngram_counts(df, "k", "t", n).collect()} == want


def test_every_document_has_its_ngrams(spark):
    from tests.conftest import SF
    from tidemark.plans import load

    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 2")
    assert load()[0]["char_ngrams"](spark, SF).count() == docs.count() > 150


def test_asof_with_a_hot_key(spark):
    """One key with all rows, a null key and ties: by blocks of time as by a search."""
    r = random.Random(6)
    day = dt.date(2020, 1, 1)
    key = lambda: r.choice(["hot"] * 8 + ["cold", None])
    lefts = [(key(), i, day + dt.timedelta(r.randrange(900))) for i in range(1500)]
    rights = [(key(), day + dt.timedelta(r.randrange(100, 900)), r.randrange(50)) for _ in range(400)]
    df = joins.asof_backward(spark.createDataFrame(lefts, "k string, i int, t date"), spark.createDataFrame(rights, "k string, s date, v int"), "k", "t", "s", ["s", "v"])
    got = {x.i: None if x.fact is None else (x.fact.s, x.fact.v) for x in df.collect()}
    for k, i, t in lefts:
        assert got[i] == max(((s, v) for q, s, v in rights if q == k and s <= t), default=None)
    assert df.columns == ["k", "i", "t", "fact"]
    empty = spark.createDataFrame([], "k string, s date, v int")
    assert {x.fact for x in joins.asof_backward(spark.createDataFrame(lefts[:9], "k string, i int, t date"), empty, "k", "t", "s", ["s", "v"]).collect()} == {None}
