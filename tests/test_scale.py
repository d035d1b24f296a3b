"""Queries on tables made here: sizes at which earlier versions went wrong or grew too fast."""

import datetime
import random
import statistics

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from tidemark.operators import evaluate, portfolio
from tidemark.plans import eval_queries, load, panel_queries, rules_queries
from tidemark.sources import stages

QUERIES, ORACLES = load()


def lines(folder, rows):
    """A lineitem of (supplier, week from 1997 on, price)."""
    day = datetime.datetime(1996, 12, 30)
    table = {
        "l_orderkey": list(range(len(rows))), "l_partkey": [1] * len(rows), "l_suppkey": [r[0] for r in rows], "l_linenumber": [1] * len(rows), "l_quantity": [1.0] * len(rows),
        "l_extendedprice": [float(r[2]) for r in rows], "l_discount": [0.0] * len(rows), "l_tax": [0.0] * len(rows), "l_shipdate": pa.array([day + datetime.timedelta(7 * r[1]) for r in rows], pa.timestamp("us")),
    }
    pq.write_table(pa.table(table), f"{folder}/lineitem.parquet")
    return str(folder)


def test_api_predicates_orders_by_what_it_shows(spark, tmp_path):
    # At week 12 there are 1,200 entities and at week 13 one more: their second places differ in the seventh digit only.
    entities = range(1, 1202)
    d = lines(tmp_path, [(e, w, 100 + (e if w > 11 else 0)) for e in entities for w in range(14) if e > 1 or w != 12])
    got = [tuple(r) for r in QUERIES["api_predicates"](spark, d).select("entity", "date", "p").collect()]
    db = duckdb.connect()
    db.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{d}/lineitem.parquet'")
    want = db.sql(f"SELECT entity, date, p FROM ({ORACLES['api_predicates']})").fetchall()
    assert got == want and any(a[1] < b[1] for a, b in zip(want, want[2:], strict=False))


def stepwise(rows, n, bps):
    """The ledger of one strategy over all rows, day by day."""
    cash, units, marks, out = 1.0, {}, {}, []
    for date in sorted({r[1] for r in rows}):
        day = {e: (s, p) for _, t, e, s, p in rows if t == date}
        price = {e: p for e, (_, p) in day.items() if p is not None and p > 0}
        marks |= price
        wanted = [e for _, e in sorted((-day[e][0], e) for e in price if day[e][0] is not None)[:n]]
        nav, traded = cash + sum(u * marks[e] for e, u in units.items()), 0.0
        for e in sorted(set(units) & set(price)):
            less = max(units[e] * price[e] - (nav / n if e in wanted else 0.0), 0.0)
            cash, traded = cash + less * (1 - bps / 1e4), traded + less
            units[e] -= less / price[e]
            if e not in wanted:
                del units[e]
        for e in wanted:
            more = min(max(nav / n - units.get(e, 0.0) * price[e], 0.0), cash / (1 + bps / 1e4))
            units[e] = units.get(e, 0.0) + more / price[e]
            cash, traded = cash - more * (1 + bps / 1e4), traded + more
        out.append((date, cash + sum(u * marks[e] for e, u in units.items()), cash, len(units), traded))
    return out


def test_ledger_folds_what_is_traded_only(spark):
    r = random.Random(4)
    day = datetime.date(2024, 1, 1)
    rows = []
    for i in range(40):
        for e in range(60):
            if r.random() < 0.85:
                closed = i in (7, 20)  # dates on which nothing can be traded
                rows.append(("s", day + datetime.timedelta(i), 2**60 + e, r.choice([None, round(r.random(), 1)]), None if closed or r.random() < 0.1 else r.choice([0.0, 10 + r.random(), 11.0])))
    df = spark.createDataFrame(rows, "strategy string, date date, entity long, score double, price double")
    kept = portfolio.traded_rows(df, 3)
    assert kept.count() <= 2 * 3 * 40 and kept.count() * 5 < len(rows)
    for bps in (0.0, 50.0):
        got = portfolio.ledger(df, 3, bps).orderBy("date").collect()
        want = stepwise(rows, 3, bps)
        assert [x.date for x in got] == [w[0] for w in want] and [x.n_held for x in got] == [w[3] for w in want]
        assert all(abs(a - b) < 1e-9 for x, w in zip(got, want, strict=True) for a, b in ((x.nav, w[1]), (x.cash, w[2]), (x.traded, w[4])))


def test_policy_grid_has_every_size(spark, tmp_path):
    # The grid had one size; every cell is held against a ledger folded over all rows of its strategy.
    r = random.Random(6)
    d = lines(tmp_path, [(e, w, round(100 + 30 * r.random(), 2)) for e in range(45) for w in range(30) if r.random() < 0.8])
    rows = [(x.strategy, x.date, x.entity, x.score, x.price) for x in eval_queries.signals(spark, d).collect()]
    got = {(x.strategy, x["size"], x.bps): (x.nav, x.traded) for x in QUERIES["policy_grid"](spark, d).collect()}
    assert set(got) == {(f, n, bps) for f in ("ret_4", "ret_12") for n in (10, 20, 30) for bps in (0.0, 20.0)}
    for (f, n, bps), (nav, traded) in got.items():
        want = stepwise([x for x in rows if x[0] == f], n, bps)
        assert abs(nav - want[-1][1]) < 1e-9 and abs(traded - sum(w[4] for w in want)) < 1e-9
    assert len({nav for nav, _ in got.values()}) == len(got)


def test_parts_grow_with_the_table(spark, tmp_path, monkeypatch):
    # AQE gives small shuffles few tasks, however wide their rows are sorted: parts go by the number of rows.
    d = lines(tmp_path, [(e, w, 100 + (e * w) % 7) for e in range(50) for w in range(20)])
    monkeypatch.setattr(stages, "ROWS", 20)
    for df in (panel_queries.by_date(panel_queries.labeled(spark, d), spark, d), panel_queries.returns(spark, d), QUERIES["row_means"](spark, d)):
        assert df.rdd.getNumPartitions() == 50
    ics = evaluate.rank_ic_matrix(panel_queries.labeled(spark, d), ["ret_1", "ret_4"], "label", "date", 5, 1000)
    plain = evaluate.rank_ic_matrix(panel_queries.labeled(spark, d), ["ret_1", "ret_4"], "label", "date", 5)
    assert ics.rdd.getNumPartitions() == 50 and sorted(ics.collect()) == sorted(plain.collect())


def test_tails_of_one_key_are_spread(spark):
    # All rows are of one date: places and ranks are windows over ranges of a sort, never over the date alone.
    r = random.Random(9)
    rows = [(datetime.date(2024, 1, 1), e, float(r.randrange(90)), r.randrange(9) / 8 - 0.5) for e in range(400)]
    df = spark.createDataFrame([*rows, (datetime.date(2024, 2, 1), 1, 1.0, 0.5)], "date date, entity long, score double, label double").repartition(5)
    got = evaluate.tail_metrics(df, "score", "label", "date", "entity")
    windows = [x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in x]
    assert windows and all("__part" in x for x in windows)
    row = got.collect()
    assert len(row) == 1 and row[0].n == 400
    placed = sorted(rows, key=lambda x: (-x[2], x[1]))

    def rho(part):
        def ranks(values):
            return [sum(w < v for w in values) + (values.count(v) + 1) / 2 for v in values]

        return statistics.correlation(ranks([x[2] for x in part]), ranks([x[3] for x in part]))

    for name, part in (("overall_rank_ic", placed), ("top_decile_ic", placed[:40]), ("top_quintile_ic", placed[:80]), ("bottom_decile_ic", placed[-40:])):
        assert abs(row[0][name] - rho(part)) < 1e-9


def test_many_quantiles_cost_a_row_no_more(spark):
    # Each probability used to be two aggregates over all values.
    df = spark.createDataFrame([("ab"[i % 2], float(i * i % 101)) for i in range(500)], "k string, x double")
    plan = lambda n, *keys: evaluate.quantiles(df, "x", [k / n for k in range(n + 1)], *keys)._jdf.queryExecution().optimizedPlan().toString()
    assert plan(60).count("max(") == plan(1).count("max(") and plan(60, "k").count("max(") == plan(1, "k").count("max(")
    q = evaluate.quantiles(df, "x", [k / 4 for k in range(5)]).first().q
    values = sorted(float(i * i % 101) for i in range(500))
    assert q[0] == values[0] and q[2] == statistics.median(values) and q[4] == values[-1]


def test_panel_and_ranks_sort_rows_once(spark, tmp_path):
    # Line items used to be sorted before and after they were dealt, and each factor made rows of its own for the ranks.
    d = lines(tmp_path, [(e, w, 100 + (e * w) % 7) for e in range(50) for w in range(20)])
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    rows = panel_queries.labeled(spark, d)
    assert plan(rows).count("Exchange ") == 1 and plan(rows).count("Sort [") == 1
    ics = evaluate.rank_ic_matrix(rows, ["ret_1", "ret_4", "ret_12", "volume"], "label", "date", 5, 1000)
    assert "Expand" not in plan(ics) and plan(ics).count("Sort [") == 6


def test_audit_makes_the_panel_once(spark, tmp_path, monkeypatch):
    d = lines(tmp_path, [(e, w, 100 + (e * w) % 7) for e in range(20) for w in range(60)])
    made = []
    monkeypatch.setattr(rules_queries, "labeled", lambda *a: made.append(a) or panel_queries.labeled(*a))
    monkeypatch.setattr(eval_queries, "labeled", rules_queries.labeled)
    for name in ("factor_gates", "factor_selection"):
        made.clear()
        assert QUERIES[name](spark, d).count() == 3 and len(made) == 1  # volumes are all equal


def test_pooled_ranks_deal_rows_by_ranges_of_values(spark, monkeypatch):
    # The factors' values used to become rows of their own, shuffled four times. Ties, signed zeros and a value with most rows are ranked like others, and no key holds that value's rows.
    monkeypatch.setattr(evaluate, "FEW_VALUES", 20)
    monkeypatch.setattr(stages, "ROWS", 100)
    r = random.Random(5)
    inf = float("inf")
    rows = [(i, r.choice([None, 0.5, 0.5, 0.5, r.gauss(0, 1)]), r.choice([0.0, -0.0, r.gauss(0, 1)]), float(r.randrange(9)), r.choice([inf, -inf, float("nan"), *(r.randrange(300) / 7 for _ in range(40))])) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double")
    got = evaluate.pooled_spearman(df, ["a", "b", "c", "d"], len(rows))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and plan.count("Window [") == 3  # c has few values
    full = [x[1:] for x in rows if x[1] is not None and x[4] == x[4]]

    def ranks(values):
        below = {v: sum(w < v for w in values) + (values.count(v) + 1) / 2 for v in set(values)}
        return [below[v] for v in values]

    by = dict(zip("abcd", map(ranks, zip(*full, strict=True)), strict=True))
    rho = {(x.f, x.g): x.rho for x in got.collect()}
    assert sorted(rho) == [(f, g) for f in "abcd" for g in "abcd" if f < g]
    assert all(abs(v - statistics.correlation(by[f], by[g])) < 1e-9 for (f, g), v in rho.items())
    assert evaluate.pooled_spearman(df.where("id < 0"), ["a", "b"], 0).collect() == [("a", "b", None)]
