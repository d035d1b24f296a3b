"""Where queries and their SQL are collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Common tables of the SQL.
_ORDER = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity"
PANEL = f"""lines AS (SELECT l_suppkey AS entity, CAST(date_trunc('week', l_shipdate) AS DATE) AS date, l_extendedprice / l_quantity AS price, * FROM lineitem),
panel AS (SELECT entity, date, first(price ORDER BY {_ORDER}) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY {_ORDER}) AS close,
  sum(l_quantity) AS volume, sum(l_extendedprice) AS amount FROM lines GROUP BY entity, date)"""
SECTORS = "sectors AS (SELECT s_suppkey AS entity, n_name AS industry, r_name AS sector FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
RETURNS = f"""{PANEL}, rets AS (SELECT *, close / lag(close, 1) OVER w - 1 AS ret_1, close / lag(close, 4) OVER w - 1 AS ret_4, close / lag(close, 12) OVER w - 1 AS ret_12 FROM panel
  WINDOW w AS (PARTITION BY entity ORDER BY date))"""
LABELS = f"""{RETURNS}, labeled AS (SELECT *, lead(open, 1) OVER w AS entry_open, lead(open, 3) OVER w AS exit_open, lead(date, 3) OVER w AS label_end,
  lead(open, 3) OVER w / lead(open, 1) OVER w - 1 AS label FROM rets WINDOW w AS (PARTITION BY entity ORDER BY date))"""
CALENDAR = "calendar AS (SELECT date, row_number() OVER (ORDER BY date) AS session FROM (SELECT DISTINCT date FROM panel))"
FILINGS = """filings AS (SELECT o_custkey AS entity, CAST(date_trunc('month', o_orderdate) AS DATE) AS report, sum(o_totalprice) AS total, count(*) AS n_orders,
  CAST(last_day(CAST(date_trunc('month', o_orderdate) AS DATE)) + INTERVAL 10 DAY AS DATE) AS available FROM orders GROUP BY ALL)"""


def rank_sql(value: str, keys: str) -> str:
    """Average-tie percentile rank in SQL."""
    return (
        f"CASE WHEN {value} IS NOT NULL THEN (rank() OVER (PARTITION BY {keys} ORDER BY {value} NULLS LAST) + (count({value}) OVER (PARTITION BY {keys}, {value}) - 1) / 2.0)"
        f" / count({value}) OVER (PARTITION BY {keys}) END"
    )


def cross_sql(period: str) -> str:
    """Orders as one wide cross-section per period."""
    return f"""cross_rows AS (SELECT o_orderkey AS entity, CAST(date_trunc('{period}', o_orderdate) AS DATE) AS date, o_totalprice AS score, round(((o_custkey * 7919 + o_orderkey * 31) % 1009) / 1009.0 - 0.5, 6) AS label,
 round((o_orderkey * 104729 % 997) / 997.0, 6) AS size, round((o_custkey * 31337 % 991) / 991.0, 6) AS momentum, n_name AS industry, r_name AS sector
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def cdf_sql(x: str) -> str:
    """Standard normal distribution function of a number that isn't negative, by Abramowitz and Stegun 7.1.26."""
    t = f"(1 / (1 + 0.3275911 * {x} / sqrt(2)))"
    poly = f"{t} * (0.254829592 + {t} * (-0.284496736 + {t} * (1.421413741 + {t} * (-1.453152027 + {t} * 1.061405429))))"
    return f"(0.5 * (2 - ({poly}) * exp(-{x} * {x} / 2)))"


def residual_sql(src: str, y: str, controls: list[str], keys: str, group: str | None, least: int = 20) -> str:
    """CTEs that end in ``cleared`` (the rows of src with residual): demeaned, then each control cleared of those before it."""
    cell = f"{keys}, coalesce({group}, 'UNKNOWN')" if group else keys
    xs = [f"x{i}" for i in range(len(controls))]
    steps = [f"r0 AS (SELECT *, CAST({y} AS DOUBLE) AS y_, count(*) OVER (PARTITION BY {keys}) AS n_" + "".join(f", coalesce({c}, 0) AS {x}" for c, x in zip(controls, xs, strict=True)) + f" FROM {src} WHERE {y} IS NOT NULL)"]
    names = ["y_", *xs]
    steps.append("r1 AS (SELECT * REPLACE (" + ", ".join(f"{n} - avg({n}) OVER (PARTITION BY {cell}) AS {n}" for n in names) + ") FROM r0)")
    last = "r1"
    for i, x in enumerate(xs):
        rest = ["y_", *xs[i + 1 :]]
        slope = lambda n, x=x: f"CASE WHEN sum({x} * {x}) OVER d > 1e-12 THEN sum({x} * {n}) OVER d / sum({x} * {x}) OVER d ELSE 0 END"
        steps.append(f"r{i + 2} AS (SELECT * REPLACE (" + ", ".join(f"{n} - {x} * {slope(n)} AS {n}" for n in rest) + f") FROM {last} WINDOW d AS (PARTITION BY {keys}))")
        last = f"r{i + 2}"
    steps.append(f"cleared AS (SELECT *, CASE WHEN n_ >= {least} THEN y_ END AS residual FROM {last})")
    return ", ".join(steps)


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(*names: str) -> list[Column]:
    """Columns rounded to six places, so that the order of additions doesn't show."""
    return [F.round(F.col(n).cast("double"), 6).alias(n) for n in names]


#: Added before rounding where exact results of six-digit inputs (halves of a last digit) would fall between two six-digit numbers.
SHIFT = 1.234567891e-7


def s6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)
