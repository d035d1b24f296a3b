"""Steps that are computed once: written to the folder that driver and executors share, and read again."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, a temporary one of a session in one process."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows with their lineage cut; survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/tidemark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a source table to a task, where ``dealt`` knows their number.
ROWS = 250_000


def parts_of(spark: SparkSession, rows: int) -> int:
    """Number of parts that ``dealt`` makes of so many rows."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // ROWS))


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df by keys in parts for windows over them, as many as ``rows`` (of the table it comes from) ask for: what a task sorts and holds stays the same when tables grow, down to one group of keys."""
    return df.repartition(parts_of(df.sparkSession, rows), *keys)


def running(df: DataFrame, keys: list[str], order: list[Column | str], value: Column | dict[str, Column], name: str) -> DataFrame:
    """df with ``name``: the sum of ``value`` over the earlier rows of the same keys, in an order that tells rows apart; several sums by name if ``value`` is a dictionary.

    Rows are sorted in ranges of about equal size, summed within each range and key, and the ranges' sums are added
    up, so a key with all rows is spread like any other.
    """
    values = value if isinstance(value, dict) else {name: value}
    placed = df.withColumns({f"__v_{n}": v for n, v in values.items()}).repartitionByRange(*map(_column, keys), *map(_column, order)).sortWithinPartitions(*map(_column, keys), *map(_column, order))
    placed = written(placed.withColumn("__at", F.monotonically_increasing_id()), f"running-{name}").withColumn("__part", F.shiftright("__at", 33))
    part = Window.partitionBy("__part", *keys).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("__part", *keys).agg(*(F.sum(f"__v_{n}").alias(f"__s_{n}") for n in values))
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range and key
    same = lambda c: F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    first = parts.select("__part", *keys, *(F.sum(f"__s_{n}").over(earlier).alias(f"__f_{n}") for n in values))
    own = placed.withColumns({f"__o_{n}": F.sum(f"__v_{n}").over(part) for n in values})
    both = own.alias("a").join(first.alias("b"), reduce(Column.__and__, map(same, ["__part", *keys])))
    both = both.select("a.*", *(f"__f_{n}" for n in values))
    zero = {n: F.lit(0).cast(placed.schema[f"__v_{n}"].dataType) for n in values}
    both = both.withColumns({n: F.coalesce(f"__o_{n}", zero[n]) + F.coalesce(f"__f_{n}", zero[n]) for n in values})
    return both.drop("__at", "__part", *(f"__{x}_{n}" for n in values for x in "vof"))


def numbered(df: DataFrame, order: list[Column | str], name: str = "n", keys: list[str] | None = None) -> DataFrame:
    """df with the number of each row (from 0) within its keys, in an order that tells rows apart.

    Rows are sorted in ranges of about equal size and written once with their place in the range; a key's rows in a range are side by
    side, so its first place there and its rows in the ranges before are all that numbers take.
    """
    keys = keys or []
    by = [*map(_column, keys), *map(_column, order)]
    placed = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id())
    placed = written(placed, f"numbered-{name}").withColumn("__part", F.shiftright("__at", 33))
    parts = placed.groupBy("__part", *keys).agg(F.min("__at").alias("__first"), F.count("*").alias("__k"))
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range and key
    first = parts.select("__part", *keys, (F.coalesce(F.sum("__k").over(earlier), F.lit(0)) - F.col("__first")).alias("__from"))
    same = lambda c: F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    both = placed.alias("a").join((first if keys else F.broadcast(first)).alias("b"), reduce(Column.__and__, map(same, ["__part", *keys])))
    return both.select("a.*", "__from").withColumn(name, F.col("__at") + F.col("__from")).drop("__at", "__part", "__from")


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
