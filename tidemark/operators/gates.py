"""Market regimes, timing by the market's own history, and confidence from validation years."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.expr import finite
from tidemark.operators import evaluate

#: Bounds of a regime: mean momentum and share of rising members.
RISK_ON, RISK_OFF = (0.02, 0.55), (-0.02, 0.45)
#: Timing: sessions of the momentum, least covered weight, bounds, and the weight of each regime.
WINDOW, COVERAGE, BULL, BEAR = 20, 0.95, 0.02, -0.02
WEIGHTS = {"bull": 0.50, "neutral": 0.65, "bear": 0.80}


def market_regime(df: DataFrame, momentum: str, ret: str, eligible: Column) -> DataFrame:
    """date, momentum, breadth, regime: mean momentum and share of positive returns (an unknown one isn't positive) of the eligible rows; neutral between the bounds or without such rows."""
    own = F.coalesce(eligible, F.lit(False))
    up = F.when(own, F.coalesce(F.col(ret) > 0, F.lit(False)).cast("double"))
    out = df.groupBy("date").agg(F.avg(F.when(own, F.col(momentum))).alias("momentum"), F.avg(up).alias("breadth"))
    on = (F.col("momentum") > RISK_ON[0]) & (F.col("breadth") > RISK_ON[1])
    off = (F.col("momentum") < RISK_OFF[0]) & (F.col("breadth") < RISK_OFF[1])
    return out.withColumn("regime", F.when(on, "risk_on").when(off, "risk_off").otherwise("neutral"))


def market_timing(df: DataFrame, sessions: DataFrame, window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """date, market_return, covered_weight, market_momentum, regime and weight, from members' closes and the weights known a session before.

    df: entity, date, close, benchmark_weight, in_universe (a row per entity and date); sessions: date, session. A member counts
    where it has a close at this and the last session. A session that covers too little weight has no return, and a date
    whose last ``window`` sessions don't all have one has neither regime nor weight.
    """
    w = F.when(F.coalesce("in_universe", F.lit(False)), F.greatest(F.coalesce(F.col("benchmark_weight").cast("double"), F.lit(0.0)), F.lit(0.0))).otherwise(0.0)
    rows = df.join(sessions, "date").withColumn("__w", w)
    rows = rows.withColumn("__w", F.try_divide("__w", F.nullif(F.sum("__w").over(Window.partitionBy("date")), F.lit(0.0))))
    own = Window.partitionBy("entity").orderBy("session")
    follows = F.col("session") - F.lag("session").over(own) == 1
    before, was = F.lag("close").over(own), F.lag("__w").over(own)
    ret = finite(F.try_divide(F.col("close").cast("double"), F.when(before > 0, before.cast("double"))) - 1)
    rows = rows.withColumns({"__r": F.when(follows, ret), "__was": was}).withColumn("__c", F.when(F.col("__r").isNotNull(), F.coalesce("__was", F.lit(0.0))).otherwise(0.0))
    daily = rows.groupBy("date").agg(F.sum(F.col("__r") * F.col("__c")).alias("__sum"), F.sum("__c").alias("covered_weight"))
    daily = sessions.join(daily, "date", "left").withColumn("market_return", F.when(F.col("covered_weight") >= coverage, F.try_divide("__sum", F.nullif("covered_weight", F.lit(0.0)))))
    last = Window.orderBy("session").rowsBetween(-(window - 1), 0)  # a row per date
    daily = daily.withColumn("market_momentum", F.when(F.count("market_return").over(last) == window, F.product(1 + F.col("market_return")).over(last) - 1))
    regime = F.when(F.col("market_momentum") > BULL, "bull").when(F.col("market_momentum") < BEAR, "bear").when(F.col("market_momentum").isNotNull(), "neutral")
    daily = daily.withColumn("regime", regime)
    weight = F.create_map(*(F.lit(x) for kv in WEIGHTS.items() for x in kv))[F.col("regime")]
    return daily.select("date", "market_return", "covered_weight", "market_momentum", "regime", weight.alias("weight"))


def confidence_from_years(metrics: DataFrame, key: str, year: str, names: list[str]) -> DataFrame:
    """key and confidence from the two years of validation: 1 where all measures of both and their means are positive, 0.5 with one such year and positive means, 0.25 where any mean is positive, else 0; 0 with an unknown measure, null unless there are two years."""
    good = F.lit(True)
    for n in names:
        good &= F.col(n) > 0
    known = F.count(F.when(sum((F.col(n).isNull().cast("int") for n in names), F.lit(0)) == 0, 1))
    out = metrics.groupBy(key).agg(F.count(year).alias("__years"), known.alias("__known"), F.count(F.when(good, 1)).alias("__good"), *(F.avg(n).alias(f"__{i}") for i, n in enumerate(names)))
    means = [F.col(f"__{i}") > 0 for i in range(len(names))]
    every, some = F.lit(True), F.lit(False)
    for m in means:
        every, some = every & m, some | m
    tier = F.when(F.col("__known") < 2, 0.0).when((F.col("__good") == 2) & every, 1.0).when((F.col("__good") >= 1) & every, 0.5).when(some, 0.25).otherwise(0.0)
    return out.select(key, F.when(F.col("__years") == 2, tier).alias("confidence"))


def lower_bound(value: str, z: float) -> Column:
    """Mean less z standard errors (ddof 1), as an aggregate; null for fewer than two values."""
    n = F.count(value)
    return F.when(n >= 2, F.avg(value) - z * F.stddev_samp(value) / F.sqrt(n.cast("double")))


def _told(gate: str, one: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """gate, measure, value, passed (null: not) of a table of one row."""
    rows = F.array(*(F.struct(F.lit(n).alias("measure"), F.col(n).cast("double").alias("value"), F.coalesce(c, F.lit(False)).alias("passed")) for n, c in checks.items()))
    return one.select(F.lit(gate).alias("gate"), F.inline(rows))


def ranking_gate(df: DataFrame, score: str, near: str, far: str, group: str, value: str, years: int = 4, least: int = 5) -> DataFrame:
    """Mean daily rank correlations of a score with a near and a far target and, within one group, with the near one; years whose near mean is positive. df: date and eligible rows."""

    def ic(rows: DataFrame, target: str, name: str) -> DataFrame:
        known = rows.where(F.col(score).isNotNull() & F.col(target).isNotNull())
        return evaluate.rank_ic(known, score, target, ["date"], least).select("date", F.col("ic").alias(name))

    daily = df.select("date").distinct().join(ic(df, near, "a"), "date", "left").join(ic(df, far, "b"), "date", "left").join(ic(df.where(F.col(group) == value), near, "c"), "date", "left")
    by = daily.groupBy(F.year("date").alias("y")).agg(F.avg("a").alias("m")).agg(F.count(F.when(F.round("m", 12) > 0, 1)).alias("positive_near_years"))
    one = daily.agg(F.avg("a").alias("mean_near_ic"), F.avg("b").alias("mean_far_ic"), F.avg("c").alias("group_near_ic")).crossJoin(by)  # one row each
    c = F.col
    return _told("ranking", one, {"mean_near_ic": c("mean_near_ic") > 0, "mean_far_ic": c("mean_far_ic") > 0, "positive_near_years": c("positive_near_years") >= years, "group_near_ic": c("group_near_ic") >= 0})


def selection_gate(df: DataFrame, score: str, near: str, far: str, group: str, tie: str, quantile: float = 0.8, years: int = 4, least: int = 10) -> DataFrame:
    """What the best of each group by score earn above its others, on the near and the far target, and how many of them are among its best by the near target above chance.

    Means of groups with ``least`` rows per date, then of dates. df: date and eligible rows; equal scores and targets come by ``tie``.
    """
    cell = Window.partitionBy("date", group)

    def best(c: str) -> Column:
        place = F.row_number().over(cell.orderBy(F.col(c).asc_nulls_last(), tie)) / F.count(c).over(cell)
        return F.coalesce(F.col(c).isNotNull() & (F.round(place, 9) > quantile), F.lit(False))

    rows = df.withColumn("__n", F.count("*").over(cell)).where(F.col("__n") >= least).withColumns({"__top": best(score), "__true": best(near)})
    spread = lambda t: F.avg(F.when(F.col("__top"), F.col(t))) - F.avg(F.when(~F.col("__top"), F.col(t)))
    lift = F.avg(F.when(F.col("__top") & F.col(near).isNotNull(), F.col("__true").cast("double"))) - (1 - quantile)
    cells = rows.groupBy("date", group).agg(spread(near).alias("a"), spread(far).alias("b"), lift.alias("c"))
    daily = cells.groupBy("date").agg(*(F.avg(x).alias(x) for x in "abc"))
    by = daily.groupBy(F.year("date").alias("y")).agg(F.avg("a").alias("m")).agg(F.count(F.when(F.round("m", 12) > 0, 1)).alias("positive_near_years"))
    one = daily.agg(F.avg("a").alias("mean_near_spread"), F.avg("b").alias("mean_far_spread"), F.avg("c").alias("precision_lift")).crossJoin(by)  # one row each
    c = F.col
    return _told("selection", one, {"mean_near_spread": c("mean_near_spread") > 0, "mean_far_spread": c("mean_far_spread") > 0, "positive_near_years": c("positive_near_years") >= years, "precision_lift": c("precision_lift") > 0})


def conversion_gate(candidate: DataFrame, control: DataFrame, periods: float = 252 / 20, years: int = 4, floor: float = -0.10, tracking: float = 0.06) -> DataFrame:
    """Cumulative excess, years ahead, active drawdown and tracking error of a candidate's periods, and its mean turnover and cost against a control's. Both: date, period_return, benchmark_return, turnover, cost (a row per period)."""
    order = Window.orderBy("date")  # a row per period
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = candidate.withColumn("__active", F.product(1 + F.col("period_return")).over(upto) / F.product(1 + F.col("benchmark_return")).over(upto))
    rows = rows.withColumn("__down", F.col("__active") / F.max("__active").over(upto) - 1)
    gain = lambda c: F.product(1 + F.col(c)) - 1
    by = rows.groupBy(F.year("date").alias("y")).agg((gain("period_return") - gain("benchmark_return")).alias("e")).agg(F.count(F.when(F.round("e", 12) > 0, 1)).alias("positive_excess_years"))
    one = rows.agg(
        (gain("period_return") - gain("benchmark_return")).alias("excess_return"), F.min("__down").alias("active_max_drawdown"), (F.stddev_samp(F.col("period_return") - F.col("benchmark_return")) * periods**0.5).alias("tracking_error"),
        F.avg("turnover").alias("average_turnover"), F.avg("cost").alias("average_cost"),
    )
    one = one.crossJoin(by).crossJoin(control.agg(F.avg("turnover").alias("__t"), F.avg("cost").alias("__c")))  # one row each
    c = F.col
    return _told(
        "conversion", one,
        {"excess_return": c("excess_return") > 0, "positive_excess_years": c("positive_excess_years") >= years, "active_max_drawdown": c("active_max_drawdown") >= floor, "tracking_error": c("tracking_error") <= tracking, "average_turnover": F.round(c("average_turnover") - c("__t"), 12) <= 0, "average_cost": F.round(c("average_cost") - c("__c"), 12) <= 0},
    )
