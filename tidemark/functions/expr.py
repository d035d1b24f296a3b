"""Column expressions that pandas has and Spark lacks, built from Spark's own functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

Keys = Sequence[str]


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rank_pct(value: str | Column, keys: Keys) -> Column:
    """Percentile rank with average ties among the non-null values of a group; null for null."""
    v = col(value)
    group, ties = Window.partitionBy(*keys), Window.partitionBy(*keys, v)
    place = F.rank().over(group.orderBy(v.asc_nulls_last())) + (F.count(v).over(ties) - 1) / F.lit(2.0)
    return F.when(v.isNotNull(), place / F.count(v).over(group))


def row_in(order: Sequence[str | Column], keys: Keys) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))


def size_of(keys: Keys, value: str | Column | None = None) -> Column:
    return F.count("*" if value is None else col(value)).over(Window.partitionBy(*keys))


def rank_first_bucket(row: Column, n: Column, q: int) -> Column:
    """Bucket 1..q of row number ``row`` of n by quantiles of the row numbers: edges lie at 1 + (n - 1) k / q and belong to the lower bucket."""
    bucket = F.lit(1)
    for k in range(1, q):
        bucket += (row > 1 + (n - 1) * k / F.lit(float(q))).cast("int")
    return bucket


def rolling(agg: Column, value: str | Column, keys: Keys, order: str, size: int, least: int | None = None) -> Column:
    """An aggregate over the last ``size`` rows, null unless ``least`` of them have the value (all by default)."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(size - 1), 0)
    return F.when(F.count(col(value)).over(w) >= (size if least is None else least), agg.over(w))


def pct_change(value: str, keys: Keys, order: str, k: int) -> Column:
    w = Window.partitionBy(*keys).orderBy(order)
    return F.try_divide(F.col(value), F.lag(value, k).over(w)) - 1


def clip(x: Column, low: float | Column | None = None, high: float | Column | None = None) -> Column:
    """Bounds that keep null as null."""
    out = x
    if low is not None:
        out = F.greatest(out, low if isinstance(low, Column) else F.lit(low))
    if high is not None:
        out = F.least(out, high if isinstance(high, Column) else F.lit(high))
    return F.when(x.isNotNull(), out)


def zfill(x: Column, width: int) -> Column:
    text = x.cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def places(x: str | Column, n: int) -> Column:
    """A double rounded to n places in floating point, as DuckDB does it; F.round goes by the decimal digits, which differs at halves."""
    return F.round(col(x) * 10.0**n) / 10.0**n


def finite(x: Column) -> Column:
    """Null for what isn't a finite number."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def correlation(x: str | Column, y: str | Column, least: int = 2) -> Column:
    """Pearson correlation as an aggregate over rows that have both; null for too few rows or a constant side."""
    both = col(x).isNotNull() & col(y).isNotNull()
    a, b = (F.when(both, col(c).cast("double")) for c in (x, y))
    n = F.count(F.when(both, 1))
    spread = F.sqrt(F.greatest(F.var_pop(a) * F.var_pop(b), F.lit(0.0)))
    varied = (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
    return F.when((n >= least) & varied, F.try_divide(F.covar_pop(a, b), spread))


def compound(r: str | Column) -> Column:
    return F.product(1 + col(r)) - 1


def share_of(predicate: Column) -> Column:
    """Mean of a predicate over the rows where it isn't null."""
    return F.avg(predicate.cast("double"))


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function, by Abramowitz and Stegun 7.1.26 (error below 1e-7)."""
    z = F.abs(x) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * z)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1 - poly * F.exp(-z * z)
    return 0.5 * (1 + F.signum(x) * erf)


def row_mean(*columns: str) -> Column:
    """Mean across columns of those that aren't null."""
    total, n = F.lit(0.0), F.lit(0)
    for c in columns:
        total, n = total + F.coalesce(F.col(c).cast("double"), F.lit(0.0)), n + F.col(c).isNotNull().cast("int")
    return F.try_divide(total, n)


def known_share(*columns: str) -> Column:
    """Share of the columns that aren't null."""
    return sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0)) / F.lit(float(len(columns)))
