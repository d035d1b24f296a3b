"""Draws that can be made again anywhere: moving-block bootstrap by prefix sums, and permutations by two numberings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.evaluate import pooled_ic
from tidemark.sources.stages import dealt, numbered, parts_of, running, written

#: Differences are summed as decimals, so that sums don't depend on their order.
EXACT = "decimal(38,12)"


def drawn(*parts: Column | str) -> Column:
    """A number below 2 ^ 52 from the md5 of the parts, written with colons between them."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(p if isinstance(p, Column) else F.lit(p) for p in parts))), 1, 13), 16, 10).cast("long")


def paired_bootstrap(df: DataFrame, key: str, order: str, a: str, b: str, block: int = 20, replications: int = 1000, seed: int = 42) -> DataFrame:
    """key, samples, mean_delta, ci_lower and ci_upper of the mean of a - b over the rows that have both, by moving blocks.

    A replicate is as many blocks as cover the series, the last one cut to its length; a block's sum is the
    difference of two prefix sums, so (replicate, block) rows meet a series of sums and no series is copied. Starts are drawn by
    hash. Fewer than two blocks of rows have no bounds; orders must be distinct within a key.
    """
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(key, order, F.round(F.col(a) - F.col(b), 12).cast(EXACT).alias("delta"))
    at = numbered(rows, [order], "at", [key])
    sums = written(running(at, [key], ["at"], F.col("delta"), "before").select(key, "at", "before", "delta"), "bootstrap-sums")
    whole = sums.groupBy(key).agg(F.count("*").alias("samples"), F.sum("delta").cast(EXACT).alias("total"))
    # The sum of the first i differences, for i from 0 to n.
    prefix = sums.select(key, "at", F.col("before").cast(EXACT).alias("before")).unionByName(whole.select(key, F.col("samples").alias("at"), F.col("total").alias("before")))
    enough = whole.where(F.col("samples") >= 2 * block).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replications - 1))))
    blocks = enough.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("samples") / block) - 1)))
    start = drawn(str(seed), F.col(key).cast("string"), F.col("replicate").cast("string"), F.col("j").cast("string")) % (F.col("samples") - block + 1)
    length = F.least(F.lit(block), F.col("samples") - F.col("j") * block)
    ends = blocks.select(key, "replicate", "samples", F.explode(F.array(F.struct(start.alias("at"), F.lit(-1).alias("sign")), F.struct((start + length).alias("at"), F.lit(1).alias("sign")))).alias("e"))
    drawn_sums = ends.select(key, "replicate", "samples", "e.at", "e.sign").join(prefix, [key, "at"])
    means = drawn_sums.groupBy(key, "replicate", "samples").agg((F.sum(F.when(F.col("sign") > 0, F.col("before")).otherwise(-F.col("before"))).cast("double") / F.col("samples")).alias("mean"))
    bounds = means.groupBy(key).agg(F.percentile("mean", 0.025).alias("ci_lower"), F.percentile("mean", 0.975).alias("ci_upper"))  # `replications` rows per key
    mean = F.col("total").cast("double") / F.col("samples")
    return whole.join(bounds, key, "left").select(key, "samples", mean.alias("mean_delta"), "ci_lower", "ci_upper")


def permutation_importance(test: DataFrame, keys: Sequence[str], features: Sequence[str], label: str, score: Column, seed: int = 42) -> DataFrame:
    """feature, importance: what the pooled rank correlation of a score with the label loses when one feature is permuted over all rows.

    Rows are numbered by their keys, and once per feature by a hash of seed, feature and keys; the row of one
    number takes the value of the row of the other. Hashes are dealt in buckets by their first digits, so a place is that in the
    bucket and the rows of the buckets before. Nothing is ordered in one task; keys must tell rows apart.
    """
    names = list(features)
    spark = test.sparkSession
    rows = numbered(test.dropna(subset=[label]).select(*keys, *names, F.col(label).alias("__y")), list(keys))
    size = rows.count()
    buckets = min(4 * parts_of(spark, size), 1 << 16)
    hashed = lambda f: F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(f), *(F.col(k).cast("string") for k in keys)))
    drawn = rows.select("n", F.explode(F.array(*(F.struct(F.lit(i).alias("f"), hashed(f).alias("h"), F.col(f).alias("v")) for i, f in enumerate(names)))).alias("e")).select("n", "e.*")
    drawn = drawn.withColumn("bucket", F.floor(F.conv(F.substring("h", 1, 4), 16, 10).cast("long") * buckets / (1 << 16)).cast("int")).withColumn("h", F.unhex("h"))
    starts, before = [], [0] * len(names)
    for f, bucket, n in sorted(tuple(r) for r in drawn.groupBy("f", "bucket").count().collect()):  # a row per feature and bucket
        starts.append((f, bucket, before[f]))
        before[f] += n
    first = F.broadcast(spark.createDataFrame(starts, "f int, bucket int, before long"))
    place = F.row_number().over(Window.partitionBy("f", "bucket").orderBy("h", "n")) - 1
    mixed = dealt(drawn, size * len(names), "f", "bucket").withColumn("at", place).join(first, ["f", "bucket"])
    mixed = dealt(mixed.select((F.col("at") + F.col("before")).alias("n"), "f", "v"), size * len(names), "n").groupBy("n").agg(*(F.max(F.when(F.col("f") == i, F.col("v"))).alias(f"__o{i}") for i in range(len(names))))
    both = dealt(rows.select("n", "__y", *names), size * len(names), "n").join(mixed, "n").withColumn("__s", F.round(score, 12))
    for i, f in enumerate(names):
        changed = both.withColumns({"__own": F.col(f), f: F.col(f"__o{i}")}).withColumn(f"__s{i}", F.round(score, 12))
        both = changed.withColumn(f, F.col("__own")).drop("__own")
    scores = ["__s", *(f"__s{i}" for i in range(len(names)))]
    rho = written(pooled_ic(written(both.select("__y", *scores), "importance-scores"), scores, "__y"), "importance-rho")
    base = rho.where("score = 0").select(F.col("rho").alias("base"))
    named = F.element_at(F.array(*map(F.lit, names)), F.col("score"))
    return rho.where("score > 0").crossJoin(F.broadcast(base)).select(named.alias("feature"), (F.col("base") - F.col("rho")).alias("importance"))  # one row
