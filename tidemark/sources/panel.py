"""Panels from files and from the transaction tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.expr import finite, zfill
from tidemark.sources.stages import dealt

OHLCV = T.StructType(
    [T.StructField("date", T.StringType()), T.StructField("symbol", T.StringType()), *(T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume", "amount"))]
)


def validate_panel(df: DataFrame, order: Sequence[str | Column], width: int = 6, required: Sequence[str] = ("date", "symbol", "open", "close"), empty: str = "keep") -> DataFrame:
    """Dates and numbers coerced, codes padded, rows without date or positive open and close dropped, the first of each (date, symbol) kept.

    A required column that is missing raises an error, as does a result without rows where ``empty`` is "raise" (which reads the table).
    """
    if missing := sorted(set(required) - set(df.columns)):
        raise ValueError(f"the panel lacks columns: {missing}")
    number = lambda c: finite(F.col(c).try_cast("double"))
    out = df.withColumns({"date": F.col("date").try_cast("date"), "symbol": zfill(F.col("symbol"), width), **{c: number(c) for c in ("open", "close") if c in df.columns}})
    out = out.where("date is not null and open > 0 and close > 0")
    first = Window.partitionBy("date", "symbol").orderBy(*order)
    out = out.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    if empty == "raise" and out.isEmpty():
        raise ValueError("the panel has no valid rows")
    return out


def scan_csv(spark: SparkSession, path: str | list[str], order: Sequence[str | Column] = ("open", "close", "volume")) -> DataFrame:
    """A validated panel from CSV files of the OHLCV schema; a folder or glob is read as one table."""
    return validate_panel(spark.read.schema(OHLCV).option("header", True).csv(path), order)


def scan_union(spark: SparkSession, baseline: str, daily: str) -> DataFrame:
    """Baseline and daily files as one panel; of rows for one key the daily one counts."""
    read = lambda p, rank: spark.read.schema(OHLCV).option("header", True).csv(p).withColumn("__rank", F.lit(rank))
    return validate_panel(read(daily, 0).unionByName(read(baseline, 1)), ["__rank", "open", "close"]).drop("__rank")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def panel_week(spark: SparkSession, sf_dir: str, histories: bool = False) -> DataFrame:
    """entity (supplier), date (week), open, high, low, close (unit prices), volume, amount; for ``histories`` the line items are dealt by entity, so that they are sorted once for the weeks and for windows over them."""
    rows = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    rows = dealt(rows, n_lines(spark, sf_dir), "l_suppkey") if histories else rows
    rows = rows.withColumn("price", F.col("l_extendedprice") / F.col("l_quantity"))
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    return rows.groupBy(F.col("l_suppkey").alias("entity"), F.date_trunc("week", "l_shipdate").cast("date").alias("date")).agg(
        F.min_by("price", order).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", order).alias("close"),
        F.sum("l_quantity").alias("volume"),
        F.sum("l_extendedprice").alias("amount"),
    )


def n_lines(spark: SparkSession, sf_dir: str) -> int:
    """Rows of the table that the panel comes from, by its files' footers."""
    return read(spark, sf_dir, "lineitem").count()


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity, industry (nation), sector (region)."""
    s, n, r = (read(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(F.col("s_suppkey").alias("entity"), F.col("n_name").alias("industry"), F.col("r_name").alias("sector"))


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity (customer), report (month of orders), available (ten days after its end), total, n_orders."""
    o = read(spark, sf_dir, "orders")
    out = o.groupBy(F.col("o_custkey").alias("entity"), F.date_trunc("month", "o_orderdate").cast("date").alias("report")).agg(F.sum("o_totalprice").alias("total"), F.count("*").alias("n_orders"))
    return out.withColumn("available", F.date_add(F.last_day("report"), 10))


def demo_panel(spark: SparkSession, symbols: int = 8, periods: int = 340, seed: int = 42) -> DataFrame:
    """A deterministic synthetic panel, made where it is needed: momentum, a seasonal regime and lognormal volume by hashed noise."""
    noise = lambda *c: (F.pmod(F.xxhash64(F.lit(seed), *c), F.lit(2**31 - 1)) / F.lit(float(2**31 - 1)) - 0.5) * 3.46
    days = spark.range(periods * 7 // 5 + 7).select(F.date_sub(F.lit("2025-12-31").cast("date"), F.col("id").cast("int")).alias("date")).where("weekday(date) < 5")
    grid = days.withColumn("t", F.row_number().over(Window.orderBy(F.desc("date")))).where(F.col("t") <= periods).crossJoin(spark.range(symbols).select((F.col("id") + 1).alias("code")))
    step = 0.02 * noise("code", "t") + 0.004 * F.sin(F.col("t") / 40.0) + 0.004 * noise("code", F.floor(F.col("t") / 20))
    path = F.sum(step).over(Window.partitionBy("code").orderBy("date"))
    close = 20 * F.exp(path)
    return grid.select("date", zfill(F.col("code"), 6).alias("symbol"), (close * (1 + 0.005 * noise("t", "code"))).alias("open"), (close * 1.02).alias("high"), (close * 0.98).alias("low"), close.alias("close"), F.exp(12 + noise("code", "t", F.lit(1))).alias("volume"))


def cross_sections(spark: SparkSession, sf_dir: str, period: str) -> DataFrame:
    """Orders as one wide cross-section per period: entity, date, score, label, size, momentum, industry, sector."""
    place = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 rows at every size
    who = read(spark, sf_dir, "customer").join(F.broadcast(place), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = read(spark, sf_dir, "orders").join(who, F.col("o_custkey") == F.col("c_custkey"))
    part = lambda c, n: F.round(c % n / F.lit(float(n)), 6)
    return rows.select(
        F.col("o_orderkey").alias("entity"),
        F.to_date(F.date_trunc(period, "o_orderdate")).alias("date"),
        F.col("o_totalprice").alias("score"),
        F.round((F.col("o_custkey") * 7919 + F.col("o_orderkey") * 31) % 1009 / F.lit(1009.0) - 0.5, 6).alias("label"),
        part(F.col("o_orderkey") * 104729, 997).alias("size"),
        part(F.col("o_custkey") * 31337, 991).alias("momentum"),
        F.col("n_name").alias("industry"),
        F.col("r_name").alias("sector"),
    )


def normalize_market(tables: list[DataFrame]) -> DataFrame:
    """One table of date, symbol, open, close, volume, amount from providers' tables of either schema, without rows that have no positive price.

    A table without a ``volume`` calls its traded volume ``amount``: it becomes the volume, and the money traded is
    taken as volume times the mean of open and close.
    """
    parts = []
    for t in tables:
        n = {c: F.col(c).cast("double") if c in t.columns else F.lit(None).cast("double") for c in ("open", "close", "volume", "amount")}
        if "volume" not in t.columns:
            n["volume"], n["amount"] = n["amount"], n["amount"] * (n["open"] + n["close"]) / 2
        parts.append(t.select("date", "symbol", *(x.alias(c) for c, x in n.items())))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("open > 0 and close > 0")


def save_artifacts(folder: str, tables: dict[str, DataFrame], kind: str = "parquet") -> dict[str, str]:
    """Write each table below a folder (csv, parquet or json), refusing one that is there; name -> path."""
    if kind not in ("csv", "parquet", "json"):
        raise ValueError(f"unknown kind {kind}")
    paths = {name: f"{folder}/{name}.{kind}" for name in tables}
    for name, df in tables.items():
        writer = df.write.mode("errorifexists")
        if kind == "csv":
            writer = writer.option("header", True)
        writer.format(kind).save(paths[name])
    return paths
