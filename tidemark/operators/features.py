"""Rolling and own-history features per entity; rows are dealt and sorted by entity once for all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.expr import clip, pct_change, rank_pct, rolling

E, D = ["entity"], "date"


def momentum(df: DataFrame, lags: tuple[int, ...] = (1, 4, 12)) -> DataFrame:
    return df.withColumns({f"ret_{k}": pct_change("close", E, D, k) for k in lags})


def rolling_set(df: DataFrame, size: int = 8) -> DataFrame:
    """Mean, deviation, extremes, median and sum of the close, and the price against its mean."""
    out = {
        "ma": rolling(F.avg("close"), "close", E, D, size),
        "sd": rolling(F.stddev_samp("close"), "close", E, D, size),
        "lo": rolling(F.min("close"), "close", E, D, size, size // 2),
        "hi": rolling(F.max("close"), "close", E, D, size, size // 2),
        "med": rolling(F.percentile("close", 0.5), "close", E, D, size),
        "vol_sum": rolling(F.sum("volume"), "volume", E, D, size, 1),
    }
    return df.withColumns(out).withColumn("gap", F.try_divide("close", "ma") - 1)


def rsi(df: DataFrame, size: int = 14) -> DataFrame:
    """Relative strength by simple means of gains and losses; null without a loss."""
    delta = F.col("close") - F.lag("close").over(Window.partitionBy(*E).orderBy(D))
    out = df.withColumn("delta", delta).withColumns({"gain": clip(F.col("delta"), low=0.0), "loss": -clip(F.col("delta"), high=0.0)})
    gain, loss = (rolling(F.avg(c), c, E, D, size) for c in ("gain", "loss"))
    return out.withColumns({"avg_gain": gain, "avg_loss": loss}).withColumn("rsi", 100 - 100 / (1 + F.try_divide("avg_gain", F.nullif("avg_loss", F.lit(0.0))))).drop("delta", "gain", "loss", "avg_gain", "avg_loss")


def rolling_product(df: DataFrame, column: str, size: int, name: str) -> DataFrame:
    return df.withColumn(name, rolling(F.product(1 + F.col(column)), column, E, D, size) - 1)


def rolling_beta(df: DataFrame, y: str, x: str, size: int, name: str) -> DataFrame:
    """Slope of y on x over the window, from the moments E[xy] - E[x]E[y]; null where x is constant."""
    both = df.withColumns({"xy": F.col(x) * F.col(y), "xx": F.col(x) * F.col(x)})
    m = {c: rolling(F.avg(c), "xy", E, D, size) for c in ("xy", "xx", x, y)}
    return both.withColumns({f"m_{k}": v for k, v in m.items()}).withColumn(
        name, F.try_divide(F.col("m_xy") - F.col(f"m_{x}") * F.col(f"m_{y}"), F.nullif(F.round(F.col("m_xx") - F.col(f"m_{x}") * F.col(f"m_{x}"), 12), F.lit(0.0)))
    ).drop("xy", "xx", *(f"m_{k}" for k in m))


def so_far() -> WindowSpec:
    return Window.partitionBy(*E).orderBy(D).rowsBetween(Window.unboundedPreceding, 0)


def drawdown(df: DataFrame) -> DataFrame:
    """equity (cumulative product of 1 + ret_1), its running peak, and the fall from it."""
    out = df.withColumn("equity", F.product(1 + F.coalesce("ret_1", F.lit(0.0))).over(so_far()))
    return out.withColumn("peak", F.max("equity").over(so_far())).withColumn("drawdown", F.col("equity") / F.col("peak") - 1)


def expanding_z(df: DataFrame, column: str, least: int = 5) -> DataFrame:
    """z-score of a value among its own history so far."""
    w = so_far()
    z = F.try_divide(F.col(column) - F.avg(column).over(w), F.nullif(F.stddev_samp(column).over(w), F.lit(0.0)))
    return df.withColumn("z", F.when(F.count(column).over(w) >= least, z))


def expanding_rank(df: DataFrame, column: str, block: int = 64) -> DataFrame:
    """Percentile, with average ties, of a value among its own history so far.

    An entity's rows are taken in blocks of time. Within a block a row is compared with the rows before it; what came in
    earlier blocks is counted by running totals per value over blocks, so a history of n rows and v distinct values costs
    n * block and v * n / block steps instead of n * n.
    """
    own = Window.partitionBy(*E).orderBy(D)
    v = F.col(column)
    rows = df.withColumn("__b", F.floor((F.row_number().over(own) - 1) / block)).withColumn("__seen", F.count(column).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    here = F.collect_list(column).over(Window.partitionBy(*E, "__b").orderBy(D).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("__here", here)
    below = F.size(F.filter("__here", lambda x: x < v))
    equal = F.size(F.filter("__here", lambda x: x == v))
    rows = rows.withColumns({"__below": below, "__equal": equal}).drop("__here")
    counts = rows.where(v.isNotNull()).groupBy(*E, "__b", v.alias("__v")).agg(F.count("*").alias("__n"))
    asked = counts.select("entity", "__v").distinct().join(rows.groupBy(*E).agg(F.max("__b").alias("__last")), "entity")
    grid = asked.select("entity", "__v", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__last"))).alias("__b")).join(counts, ["entity", "__v", "__b"], "left")
    upto = Window.partitionBy("entity", "__b").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    past = Window.partitionBy("entity", "__v").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.withColumn("__eq", F.coalesce(F.sum("__n").over(past), F.lit(0))).withColumn("__lt", F.coalesce(F.sum("__eq").over(upto), F.lit(0)))
    joined = rows.join(grid.select("entity", "__b", F.col("__v").alias(column), "__eq", "__lt"), ["entity", "__b", column], "left")
    place = F.col("__below") + F.coalesce("__lt", F.lit(0)) + (F.col("__equal") + F.coalesce("__eq", F.lit(0)) + 1) / F.lit(2.0)
    return joined.withColumn("own_rank", F.when(v.isNotNull(), place / F.col("__seen"))).select(*df.columns, "own_rank")


def winsor_rank(df: DataFrame, column: str, keys: list[str], name: str, low: float = 0.01, high: float = 0.99, least: int = 5) -> DataFrame:
    """Centred percentile rank, with average ties, of a value clipped to its group's quantiles; 0 for null and for fewer than ``least`` values."""
    group = Window.partitionBy(*keys)
    bounds = F.percentile(column, F.array(F.lit(low), F.lit(high))).over(group)
    out = df.withColumns({"__b": bounds, "__n": F.count(column).over(group)})
    out = out.withColumn("__x", F.when(F.col(column).isNotNull(), F.greatest(F.col("__b")[0], F.least(F.col("__b")[1], F.col(column)))))
    return out.withColumn(name, F.when((F.col("__n") >= least) & F.col("__x").isNotNull(), rank_pct("__x", keys) - 0.5).otherwise(0.0)).drop("__b", "__n", "__x")


def eligible(df: DataFrame, features: list[str], least: int = 120, liquid: float = 0.2, days: int = 180, jump: float = 0.35) -> DataFrame:
    """df with data_quality_ok and eligible: seen often enough, liquid on its date, traded, not under special treatment, listed
    long enough, a member at that time, without a close-to-close move beyond ``jump`` in all its history, and complete.

    Columns read: entity, date, close, amount, volume, name, list_date (null: old enough), in_universe (null: no member).
    """
    own, day = Window.partitionBy("entity").orderBy("date"), Window.partitionBy("date")
    out = df.withColumns({"__move": F.abs(pct_change("close", E, D, 1)), "__seen": F.row_number().over(own), "__floor": F.percentile("amount", liquid).over(day)})
    out = out.withColumn("data_quality_ok", ~F.coalesce(F.max("__move").over(Window.partitionBy("entity")) > jump, F.lit(False)))
    ok = (
        (F.col("__seen") >= least)
        & (F.col("amount") >= F.col("__floor"))
        & (F.col("volume") > 0)
        & ~F.upper(F.coalesce("name", F.lit(""))).rlike("ST|退")
        & F.coalesce(F.datediff("date", "list_date") >= days, F.lit(True))
        & F.coalesce("in_universe", F.lit(False))
        & F.col("data_quality_ok")
    )
    for f in features:
        ok &= F.col(f).isNotNull()
    return out.withColumn("eligible", F.coalesce(ok, F.lit(False))).drop("__move", "__seen", "__floor")


def autocorrelation(df: DataFrame, column: str, size: int, name: str) -> DataFrame:
    """Covariance of a value with the one before it over the window, by both deviations (ddof 1) over theirs."""
    out = df.withColumn("__lag", F.lag(column).over(Window.partitionBy(*E).orderBy(D))).withColumn("__xy", F.col(column) * F.col("__lag"))
    mean = lambda c: rolling(F.avg(c), c, E, D, size)
    spread = rolling(F.stddev_samp(column), column, E, D, size) * rolling(F.stddev_samp("__lag"), "__lag", E, D, size)
    out = out.withColumns({"__cov": mean("__xy") - mean(column) * mean("__lag"), "__spread": spread})
    return out.withColumn(name, F.when(F.col("__spread") > 1e-15, F.col("__cov") / F.col("__spread"))).drop("__lag", "__xy", "__cov", "__spread")


def efficiency(df: DataFrame, column: str, size: int, name: str) -> DataFrame:
    """Size of the window's sum by the sum of sizes; null where all are 0."""
    out = df.withColumn("__size", F.abs(F.col(column)))
    return out.withColumn(name, F.try_divide(F.abs(rolling(F.sum(column), column, E, D, size)), F.nullif(rolling(F.sum("__size"), "__size", E, D, size), F.lit(0.0)))).drop("__size")


def lagged_median(column: str, size: int, least: int, order: str) -> Column:
    """Median over the ``size`` rows before the current one."""
    w = Window.orderBy(order).rowsBetween(-size, -1)
    return F.when(F.count(column).over(w) >= least, F.percentile(column, 0.5).over(w))
