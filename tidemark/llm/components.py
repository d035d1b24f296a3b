"""Connected components of an edge table by alternating large and small stars, each round one job on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize

ROUNDS = 40


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of the edges (a, b, longs); the root is the smallest node reached."""
    state = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    before = None
    for _ in range(ROUNDS):
        mark = state.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == before:
            break
        before = mark
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        state = materialize(small.where("a <> b").distinct(), "stars")
    else:
        raise RuntimeError("components did not settle")
    roots = state.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
