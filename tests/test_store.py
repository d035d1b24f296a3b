"""Content-addressed partitions: reused, made again one by one."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.sources.store import Store, digest


def test_partitions(spark, tmp_path):
    source = spark.createDataFrame([(i, i % 3, float(i)) for i in range(30)], "k int, part int, v double")
    made = []

    def parts(df):
        def one(p):
            made.append(p)
            return df.where(F.col("part") == int(p)).select("k", "v")

        return {p: (lambda p=p: one(p)) for p in "012"}

    def get(df, parameters):
        made.clear()
        rows, states = Store(spark, str(tmp_path)).dataset("d", digest(df), parameters, parts(df))
        assert sorted((r.k, r.partition) for r in rows.collect()) == [(i, str(i % 3)) for i in range(30)]
        return states, list(made)

    assert get(source, {"a": 1}) == (dict.fromkeys("012", "built"), ["0", "1", "2"])
    assert get(source.repartition(4).orderBy("v"), {"a": 1}) == (dict.fromkeys("012", "reused"), [])
    assert get(source, {"a": 2})[1] == ["0", "1", "2"] and get(source, {"a": 2})[1] == []
    assert get(source.withColumn("v", F.col("v") + F.when(F.col("k") == 4, 1).otherwise(0)), {"a": 1})[1] == ["0", "1", "2"]
    # A partition whose rows are damaged, gone or changed is made again, no other one is.
    folders = sorted({p.parent.parent for p in Path(tmp_path).glob("d/*/manifest/*.parquet")})
    mine = [f for f in folders if spark.read.parquet(f"{f}/manifest").first().parameters.find('"a": 2') > 0]
    mine = {spark.read.parquet(f"{f}/manifest").first().partition: f for f in mine}
    for f in (mine["1"] / "rows").glob("*.parquet"):
        f.write_bytes(b"not parquet")
    for f in (mine["1"] / "rows").glob(".*.crc"):
        f.unlink()
    assert get(source, {"a": 2}) == ({"0": "reused", "1": "repaired", "2": "reused"}, ["1"])
    spark.createDataFrame([(1, 1.0)], "k int, v double").write.mode("overwrite").parquet(str(mine["2"] / "rows"))
    assert get(source, {"a": 2}) == ({"0": "reused", "1": "reused", "2": "repaired"}, ["2"])
    for f in (mine["0"] / "manifest").glob("*"):
        f.unlink()
    assert get(source, {"a": 2})[0]["0"] == "built"
    with pytest.raises(ValueError, match="at least one"):
        Store(spark, str(tmp_path)).dataset("d", "x", {}, {})
