"""Panels through files: scans of CSV folders, appended days, tables written once and artifacts read back, each beside SQL over the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.evidence_queries import _folder, _take
from tidemark.plans.registry import PANEL, SHIFT, query
from tidemark.sources import evidence, panel
from tidemark.sources.panel import panel_week
from tidemark.sources.stages import written
from tidemark.streaming import intake

BARS = ("open", "high", "low", "close", "volume", "amount")
#: Decides which rows are damaged.
_MARK = "(entity * 31 + date_diff('day', DATE '1992-01-01', date)) % 41"
_CODE = "lpad(CAST(entity AS VARCHAR), 6, '0') AS symbol"


def _r(name: str) -> Column:
    """A price rounded off ties: cents over up to 50 pieces often end halfway between two six-digit numbers."""
    return F.round(F.col(name) + SHIFT, 6).alias(name)


def _s(*names: str) -> str:
    return ", ".join(f"round({n} + {SHIFT}, 6) AS {n}" for n in names)


def _bars(spark: SparkSession, d: str) -> DataFrame:
    """The weekly panel as a provider would send it (date as text, code without padding), with ``k``, which decides on damage."""
    mark = (F.col("entity") * 31 + F.datediff("date", F.lit("1992-01-01"))) % 41
    return panel_week(spark, d).select(F.col("date").cast("string").alias("date"), F.col("entity").cast("string").alias("symbol"), *BARS, mark.alias("k"))


def _csv(df: DataFrame, path: str) -> str:
    df.write.option("header", True).csv(path)
    return path


@query(f"WITH {PANEL} SELECT date, {_CODE}, {_s(*BARS)} FROM panel WHERE {_MARK} NOT IN (3, 5, 7)")
def scan_panel_csv(spark, d):
    """A folder of CSV files with unreadable dates, negative opens, missing closes and repeated keys, validated."""
    k, bars = F.col("k"), _bars(spark, d)
    bad = bars.withColumns({"date": F.when(k == 3, "n/a").otherwise(F.col("date")), "open": F.when(k == 5, -F.col("open")).otherwise(F.col("open")), "close": F.when(k != 7, F.col("close"))})
    bad = bad.unionByName(bars.where("k = 11").withColumn("open", F.col("open") + 1)).unionByName(bars.where("k = 13"))
    return panel.scan_csv(spark, _csv(bad.drop("k"), _folder(spark, "bars"))).select("date", "symbol", *map(_r, BARS))


@query(
    f"""WITH {PANEL} SELECT date, {_CODE}, round(CASE WHEN date >= DATE '1996-07-01' THEN close * 1.5 ELSE close END + {SHIFT}, 6) AS close, {_s("open", "volume")} FROM panel"""
)
def scan_dir_union(spark, d):
    """A baseline up to 1996 and later files that overlap it by half a year; the later ones count."""
    bars = _bars(spark, d).drop("k")
    base = _csv(bars.where("date < '1997-01-01'"), _folder(spark, "baseline"))
    later = bars.where("date >= '1996-07-01'").withColumn("close", F.col("close") * 1.5)
    daily = _csv(later.repartition(F.substring("date", 1, 7)), _folder(spark, "daily"))
    return panel.scan_union(spark, base, daily).select("date", "symbol", *map(_r, ("close", "open", "volume")))


@query(
    f"""WITH {PANEL}, a AS (SELECT entity, CASE WHEN {_MARK} <> 3 THEN date END AS date, close, (year(date) - 1992) // 2 + (entity % 19 = 0)::INT AS batch FROM panel)
SELECT entity, date, {_s('close')}, batch, CASE WHEN date IS NULL THEN 'no_day' WHEN min(batch) OVER (PARTITION BY date) < batch THEN 'known_day' END AS reason FROM a"""
)
def append_daily_bars(spark, d):
    """Bars that arrive by two years: each day is appended once, what comes later for a known day or without a day is kept apart."""
    rows = _bars(spark, d).withColumn("entity", F.col("symbol").cast("long"))
    batch = F.floor((F.substring("date", 1, 4).cast("int") - 1992) / 2) + F.when(F.col("entity") % 19 == 0, 1).otherwise(0)
    rows = rows.select("entity", F.when(F.col("k") != 3, F.col("date").cast("date")).alias("date"), "close", batch.cast("int").alias("b"))
    rows = written(rows, "bars")
    days, mark = intake.daily(_folder(spark, "days"), "date"), _folder(spark, "progress")
    numbers = sorted(r["b"] for r in rows.select("b").distinct().collect())  # a row per batch
    _take(spark, rows, "b", lambda home, schema: days.run(spark.readStream.schema(schema).parquet(home), mark))
    number = F.element_at(F.array(*map(F.lit, numbers)), F.col("batch").cast("int") + 1).cast("long").alias("batch")  # arrivals by their own number
    good = days.accepted(spark).withColumn("reason", F.lit(None).cast("string"))
    return good.unionByName(days.rejected(spark)).select("entity", "date", _r("close"), number, "reason")


@query(f"WITH {PANEL}, n AS (SELECT count(*) AS n FROM panel) SELECT n.n AS n, attempt, outcome FROM n, (VALUES ('first', 'created'), ('again', 'identical'), ('changed', 'refused'), ('verified', 'true')) AS t(attempt, outcome)")
def immutable_sink(spark, d):
    """A table written once, written again in another order, written with one digit more, and verified against its receipt."""
    rows = written(panel_week(spark, d).select("entity", "date", F.round("close", 6).alias("close")), "closes")
    path = _folder(spark, "once")
    told = [("first", evidence.write_once(rows, path)), ("again", evidence.write_once(rows.repartition("date"), path))]
    try:
        told.append(("changed", evidence.write_once(rows.withColumn("close", F.col("close") + 1e-6), path)))
    except ValueError:
        told.append(("changed", "refused"))
    told.append(("verified", str(evidence.verify_once(spark, path)).lower()))
    n = evidence.receipt(spark, path)[0]
    return spark.createDataFrame([(n, *t) for t in told], "n long, attempt string, outcome string")


@query(
    f"""WITH {PANEL}, y AS (SELECT entity, CAST(year(date) AS INT) AS year, round(sum(amount), 2) AS amount, count(*) AS weeks FROM panel GROUP BY ALL) SELECT kind, y.* FROM y, (VALUES ('csv'), ('json'), ('parquet')) AS k(kind)"""
)
def sink_artifacts(spark, d):
    """Yearly totals saved as CSV, JSON and Parquet, and read back."""
    yearly = panel_week(spark, d).groupBy("entity", F.year("date").alias("year")).agg(F.round(F.sum("amount"), 2).alias("amount"), F.count("*").alias("weeks"))
    yearly, home, out = written(yearly, "yearly"), _folder(spark, "artifacts"), None
    for kind in ("csv", "json", "parquet"):
        path = panel.save_artifacts(home, {"yearly": yearly}, kind)["yearly"]
        back = spark.read.schema(yearly.schema).format(kind).option("header", True).load(path).withColumn("kind", F.lit(kind))
        out = back if out is None else out.unionByName(back)
    return out
