"""Point-in-time joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.evaluate import value_range
from tidemark.sources.stages import running, written


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df, whose evaluation fails where a key repeats."""
    n = F.count("*").over(Window.partitionBy(*keys))
    checked = F.when(n > 1, F.raise_error(F.lit(f"duplicate key {', '.join(keys)}")).cast("bigint")).otherwise(n)
    return df.withColumn("__n", checked).where("__n = 1").drop("__n")


def left_one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return assert_unique(left, keys).join(assert_unique(right, keys), list(keys), "left")


def asof_backward(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, columns: Sequence[str], name: str = "fact") -> DataFrame:
    """left with the struct ``name`` of ``columns`` of the last right row of its key at or before its time.

    Both sides are sorted together by key and block of time, and the last right row is carried forward within a block;
    a second window, of a row per key and block, carries it on to the blocks after. No pairs are made, and a
    key with all rows is spread over the blocks. Of right rows with one time the greatest by ``columns`` counts.
    """
    rights = right.select(F.col(key).alias("__k"), F.col(right_time).alias("__t"), F.struct(*(F.col(c) for c in columns)).alias("__fact"), F.lit(0).alias("__side"))
    lefts = left.select(F.col(key).alias("__k"), F.col(left_time).alias("__t"), F.lit(1).alias("__side"), F.struct("*").alias("__row"))
    both = written(lefts.unionByName(rights, allowMissingColumns=True).withColumn("__at", F.col("__t").cast("timestamp").cast("double")), "asof")
    both = both.withColumn("__b", value_range(both, "__at"))
    fact = F.col("__fact").isNotNull()
    ends = both.groupBy("__k", "__b").agg(F.max(F.when(fact, F.struct("__t", "__fact"))).alias("__end"))
    before = Window.partitionBy("__k").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(F.col("__k").alias("__key"), F.col("__b").alias("__block"), F.last("__end", ignorenulls=True).over(before).getField("__fact").alias("__carried"))
    own = Window.partitionBy("__k", "__b").orderBy("__t", "__side", "__fact").rowsBetween(Window.unboundedPreceding, 0)
    told = both.withColumn("__own", F.last("__fact", ignorenulls=True).over(own)).where("__side = 1")
    told = told.join(ends, F.col("__k").eqNullSafe(F.col("__key")) & (F.col("__b") == F.col("__block")), "left")
    return told.select("__row.*", F.coalesce("__own", "__carried").alias(name))


def pit_violations(df: DataFrame, known: str, decision: str) -> Column:
    """Number of rows whose fact is younger than the decision."""
    return F.count(F.when(F.col(known) > F.col(decision), 1))


def snapshot_intervals(snapshots: DataFrame, date: str) -> DataFrame:
    """snapshot, until (exclusive; null for the last) of the distinct snapshot dates."""
    days = snapshots.select(F.col(date).alias("snapshot")).distinct()
    # Snapshot dates are few: one ordered window over them.
    return days.withColumn("until", F.lead("snapshot").over(Window.orderBy("snapshot")))


def snapshot_join(panel: DataFrame, snapshots: DataFrame, keys: Sequence[str], date: str, snapshot: str) -> DataFrame:
    """panel rows with the snapshot in force at their date, and the membership row of it (left)."""
    spans = snapshot_intervals(snapshots, snapshot)
    dates = panel.select(date).distinct()
    # Dates times snapshot dates, both calendars: small whatever the panel's size.
    in_force = dates.join(spans, (F.col(date) >= F.col("snapshot")) & (F.col("until").isNull() | (F.col(date) < F.col("until")))).select(date, "snapshot")
    placed = panel.join(in_force, date, "left")
    members = snapshots.withColumnRenamed(snapshot, "snapshot").withColumn("member", F.lit(True))
    return placed.join(members, [*keys, "snapshot"], "left").withColumn("member", F.coalesce("member", F.lit(False)))


def calendar(panel: DataFrame, date: str = "date") -> DataFrame:
    """date, session: the market's trading dates, numbered from 1."""
    return panel.select(date).distinct().withColumn("session", F.row_number().over(Window.orderBy(date)))


def session_offset(panel: DataFrame, sessions: DataFrame, columns: Sequence[str], offset: int, suffix: str, entity: str = "entity") -> DataFrame:
    """panel (with session) and ``columns`` of the same entity ``offset`` market sessions later; missing stays missing."""
    later = panel.select(F.col(entity), (F.col("session") - offset).alias("session"), *(F.col(c).alias(f"{c}{suffix}") for c in columns))
    return panel.join(later, [entity, "session"], "left")


def next_session(events: DataFrame, sessions: DataFrame, date: str, lag_days: int = 1) -> DataFrame:
    """events with ``session_date``, the first trading date at or after date + lag."""
    wanted = events.select(date).distinct().withColumn("__from", F.date_add(date, lag_days))
    # As-of forward over calendars, by the day: both sides are distinct dates.
    marks = wanted.select(F.col("__from").alias("__t"), F.lit(0).alias("__s")).unionByName(sessions.select(F.col("date").alias("__t"), F.lit(1).alias("__s"))).distinct()
    w = Window.orderBy(F.desc("__t"), F.desc("__s")).rowsBetween(Window.unboundedPreceding, 0)
    found = marks.withColumn("session_date", F.last(F.when(F.col("__s") == 1, F.col("__t")), ignorenulls=True).over(w)).where("__s = 0")
    return events.join(wanted.join(found, wanted["__from"] == found["__t"]).select(date, "session_date"), date, "left")


def pre_release(actuals: DataFrame, estimates: DataFrame, key: str, release: str, published: str, source: str, withdrawn: Column, value: str) -> DataFrame:
    """actuals with consensus (mean), n_sources: of each source's latest estimate strictly before the release, unless withdrawn.

    Estimates and releases of a key are put in one order of time. Each estimate takes back what its source said before,
    so running sums of the differences give the consensus at any release: no pairs are made. Values are summed as
    decimals of nine places, exactly, and in ranges of time, so that a key with all rows is spread.
    """
    own = Window.partitionBy("__k", "__s").orderBy("__t", "__v")
    e = estimates.select(F.col(key).alias("__k"), F.col(published).alias("__t"), F.col(source).alias("__s"), F.round(F.col(value), 9).cast("decimal(28,9)").alias("__v"), withdrawn.alias("__w"))
    counts = (~F.col("__w")).cast("long")
    e = e.withColumns({"__n": counts, "__x": F.when(F.col("__w"), F.lit(0).cast("decimal(28,9)")).otherwise(F.col("__v"))})
    e = e.select("__k", "__t", *((F.col(c) - F.coalesce(F.lag(c).over(own), F.lit(0))).alias(c) for c in ("__n", "__x")), F.lit(1).alias("__side"))
    marks = actuals.select(F.col(key).alias("__k"), F.col(release).alias("__t")).distinct().withColumn("__side", F.lit(0))
    both = e.unionByName(marks, allowMissingColumns=True)
    zero = {"n_sources": F.coalesce("__n", F.lit(0).cast("long")), "__sum": F.coalesce("__x", F.lit(0).cast("decimal(28,9)"))}
    summed = running(both, ["__k"], ["__t", "__side"], zero, "releases")  # at one time the release comes first
    found = summed.where("__side = 0 and n_sources > 0").select(F.col("__k").alias(key), F.col("__t").alias(release), (F.col("__sum").cast("double") / F.col("n_sources")).alias("consensus"), "n_sources")
    return actuals.join(found, [key, release], "left")


def stitch(old: DataFrame, new: DataFrame, entity: str, date: str, price: str, tolerance: float) -> DataFrame:
    """One price history from two whose scale differs: the new one is scaled by the median ratio over the overlap, where that ratio is stable; otherwise the entity keeps the old history."""
    a, b = old.select(entity, date, F.col(price).alias("__old")), new.select(entity, date, F.col(price).alias("__new"))
    ratio = F.try_divide("__old", "__new")
    factors = (
        a.join(b, [entity, date]).groupBy(entity).agg(F.percentile(ratio, 0.5).alias("factor"), ((F.max(ratio) - F.min(ratio)) / F.percentile(ratio, 0.5)).alias("drift"))
        .where(F.col("drift") <= tolerance).select(entity, "factor")
    )
    fresh = b.join(a.select(entity, date), [entity, date], "left_anti").join(factors, entity).select(entity, date, (F.col("__new") * F.col("factor")).alias(price), F.lit("new").alias("origin"))
    return a.select(entity, date, F.col("__old").alias(price), F.lit("old").alias("origin")).unionByName(fresh)
