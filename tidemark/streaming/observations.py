"""Streams of observations: repeats, counts by window, settlement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expr import finite


def drop_repeats(stream: DataFrame, time: str, delay: str, keys: list[str]) -> DataFrame:
    """The first row of each key, with state held only as long as ``delay`` allows repeats."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, time: str, delay: str, window: str, key: str) -> DataFrame:
    """Rows per window and key; rows later than the delay are not counted (an intake keeps them as dead letters)."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, window), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def settle(predictions: DataFrame, prices: DataFrame, benchmark: DataFrame, horizon: int) -> DataFrame:
    """Predictions with status, actual and benchmark return of their entry (next session) and exit (``horizon`` later).

    predictions: entity, session; prices: entity, session, open, suspended, delisted; benchmark: session, open. What the
    last session priced at all does not reach is PENDING; the first that applies of MISSING_ENTRY_PRICE, MISSING_EXIT_PRICE,
    DELISTED_AT_EXIT, SUSPENDED_PRICE_UNAVAILABLE and MISSING_BENCHMARK_PRICE keeps a row from being SETTLED.
    """
    last = prices.agg(F.max("session").alias("last"))  # one row

    def at(k: int, name: str) -> DataFrame:
        off = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(f"{name}_{c}")
        return prices.select("entity", (F.col("session") - k).alias("session"), finite(F.col("open").cast("double")).alias(name), off("suspended"), off("delisted"))

    def index(k: int, name: str) -> DataFrame:
        return benchmark.select((F.col("session") - k).alias("session"), finite(F.col("open").cast("double")).alias(name))

    both = predictions.join(at(1, "entry"), ["entity", "session"], "left").join(at(horizon + 1, "exit"), ["entity", "session"], "left")
    both = both.join(index(1, "index_entry"), "session", "left").join(index(horizon + 1, "index_exit"), "session", "left").crossJoin(F.broadcast(last))
    status = (
        F.when(F.col("session") + horizon + 1 > F.col("last"), "PENDING")
        .when(F.col("entry").isNull(), "MISSING_ENTRY_PRICE")
        .when(F.col("exit").isNull(), "MISSING_EXIT_PRICE")
        .when(F.col("exit_delisted"), "DELISTED_AT_EXIT")
        .when(F.col("entry_suspended") | F.col("exit_suspended"), "SUSPENDED_PRICE_UNAVAILABLE")
        .when(F.col("index_entry").isNull() | F.col("index_exit").isNull(), "MISSING_BENCHMARK_PRICE")
        .otherwise("SETTLED")
    )
    settled = F.col("status") == "SETTLED"
    both = both.withColumn("status", status)
    return both.select(*predictions.columns, "status", F.when(settled, F.try_divide("exit", "entry") - 1).alias("actual"), F.when(settled, F.try_divide("index_exit", "index_entry") - 1).alias("benchmark_return"))
