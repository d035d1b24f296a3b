"""Forward labels: decide at the close, enter at the next open, leave ``horizon`` opens later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.expr import finite, rank_pct
from tidemark.operators.joins import calendar, session_offset


def open_to_open(df: DataFrame, horizon: int) -> DataFrame:
    """entry_open, exit_open, label_end and label by row offset within the entity."""
    w = Window.partitionBy("entity").orderBy("date")
    out = df.withColumns({"entry_open": F.lead("open", 1).over(w), "exit_open": F.lead("open", horizon + 1).over(w), "label_end": F.lead("date", horizon + 1).over(w)})
    return out.withColumn("label", F.try_divide("exit_open", "entry_open") - 1)


def by_session(df: DataFrame, horizon: int, threshold: float = 0.0) -> DataFrame:
    """The same on the market's calendar: an entity without a row at the entry or exit session has no label.

    Besides entry_date: raw_up and tradable_up, whether the label is above 0 and above ``threshold``; null without a label.
    """
    if horizon < 1:
        raise ValueError("the horizon must be positive")
    sessions = calendar(df)
    placed = df.join(sessions, "date")
    out = session_offset(placed, sessions, ["open"], 1, "_entry")
    later = placed.select("entity", (F.col("session") - horizon - 1).alias("session"), F.col("open").alias("open_exit"))
    out = out.join(later, ["entity", "session"], "left")
    at = lambda k, name: sessions.select((F.col("session") - k).alias("session"), F.col("date").alias(name))
    out = out.join(at(1, "entry_date"), "session", "left").join(at(horizon + 1, "label_end"), "session", "left")
    out = out.withColumn("label", finite(F.try_divide("open_exit", "open_entry") - 1))
    return out.withColumns({"raw_up": F.col("label") > 0, "tradable_up": F.col("label") > threshold})


def neutral(df: DataFrame, label: str, size: str, group: str, least: int = 5) -> DataFrame:
    """Residual of the label on the size rank and group dummies of its date: both demeaned by (date, group), one slope per date."""
    valid = F.col(label).isNotNull() & F.col(size).isNotNull()
    v = df.withColumn("y", F.when(valid, F.col(label))).withColumn("s", F.when(valid, F.col(size)))
    v = v.withColumns({"x": rank_pct("s", ["date"]) - 0.5, "n_valid": F.count("y").over(Window.partitionBy("date"))})
    g = Window.partitionBy("date", group)
    v = v.withColumns({"yd": F.col("y") - F.avg("y").over(g), "xd": F.col("x") - F.avg("x").over(g)})
    d = Window.partitionBy("date")
    sxx, sxy = F.sum(F.col("xd") * F.col("xd")).over(d), F.sum(F.col("xd") * F.col("yd")).over(d)
    slope = F.when(sxx > 1e-12, sxy / sxx).otherwise(0.0)
    return v.withColumn("neutral", F.when(F.col("n_valid") >= least, F.col("yd") - slope * F.col("xd"))).drop("y", "s", "x", "n_valid", "yd", "xd")


def maturity(label_end: Column, cutoff: Column) -> Column:
    return F.when(label_end.isNull(), "PENDING").when(label_end < cutoff, "MATURE").otherwise("PENDING")


def tail_relevance(df: DataFrame, label: str, keys: list[str], tie: str) -> DataFrame:
    """df with relevance 0 to 4 by the label's place among its group's (ties by ``tie``): above 40, 60, 80 and 90 %; 0 for null."""
    group = Window.partitionBy(*keys)
    p = F.when(F.col(label).isNotNull(), F.row_number().over(group.orderBy(F.col(label).asc_nulls_last(), tie)) / F.count(label).over(group))
    return df.withColumn("relevance", F.when(p > 0.9, 4).when(p > 0.8, 3).when(p > 0.6, 2).when(p > 0.4, 1).otherwise(0))


def nextgen(df: DataFrame, label: str, beta: str, volatility: str, weight: str) -> DataFrame:
    """beta_residual and vol_adjusted (percentile ranks per date) and robust_winsor (clipped to the date's 5 and 95 % quantiles) of a label.

    The market's return is the label's mean by benchmark weights (null or negative as 0), or its plain mean without any.
    """
    day = Window.partitionBy("date")
    w = F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0))
    market = F.coalesce(F.try_divide(F.sum(F.coalesce(label, F.lit(0.0)) * w).over(day), F.nullif(F.sum(w).over(day), F.lit(0.0))), F.avg(label).over(day))
    bounds = F.percentile(label, F.array(F.lit(0.05), F.lit(0.95))).over(day)
    out = df.withColumns({"__market": market, "__bounds": bounds})
    # Rounded, so that equal values tie however they were added up.
    out = out.withColumns({"__rest": F.round(F.col(label) - F.col(beta) * F.col("__market"), 9), "__scaled": F.round(F.col(label) / F.when(F.col(volatility).isNotNull(), F.greatest(F.abs(volatility), F.lit(1e-6))), 9)})
    out = out.withColumns({"beta_residual": rank_pct("__rest", ["date"]), "vol_adjusted": rank_pct("__scaled", ["date"]), "robust_winsor": F.when(F.col(label).isNotNull(), F.greatest(F.col("__bounds")[0], F.least(F.col("__bounds")[1], F.col(label))))})
    return out.drop("__market", "__bounds", "__rest", "__scaled")
