"""Partitions named by what they are made of: made once, verified, and made again one by one.

A partition's id hashes the dataset's name, the content of its inputs, its parameters and its own key. Its
rows are written first and its manifest (rows, content hash, schema) last; a partition without a manifest, or
whose rows no longer match it, is made again, others are read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.evidence import table_hash

MANIFEST = "partition string, id string, n long, content_hash string, schema string, parameters string"


def digest(*tables: DataFrame) -> str:
    """A hash of the tables' rows and schemas, whatever their order of rows."""
    parts = [[t.schema.simpleString(), *map(str, table_hash(t).first())] for t in tables]
    return hashlib.sha256(json.dumps(parts).encode()).hexdigest()


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    root: str

    def dataset(self, name: str, inputs: str, parameters: Mapping[str, object], parts: Mapping[str, Callable[[], DataFrame]]) -> tuple[DataFrame, dict[str, str]]:
        """The rows of all partitions with their column ``partition``, and for each whether it was reused, built, or repaired.

        inputs: the digest of what the partitions are made from; parts: how each is made. At least one partition.
        """
        states, paths = {}, {}
        for key, make in parts.items():
            body = json.dumps([name, inputs, dict(sorted(parameters.items())), key], sort_keys=True, default=str)
            ident = hashlib.sha256(body.encode()).hexdigest()
            paths[key] = path = f"{self.root}/{name}/{ident}"
            states[key] = self._state(path)
            if states[key] != "reused":
                make().write.mode("overwrite").parquet(f"{path}/rows")
                made = self.spark.read.parquet(f"{path}/rows")
                n, content = table_hash(made).first()
                row = [(key, ident, n, content, made.schema.simpleString(), body)]
                self.spark.createDataFrame(row, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")
        out = None
        for key, path in paths.items():
            one = self.spark.read.parquet(f"{path}/rows").withColumn("partition", F.lit(key))
            out = one if out is None else out.unionByName(one)
        if out is None:
            raise ValueError("a dataset has at least one partition")
        return out, states

    def _state(self, path: str) -> str:
        try:
            m = self.spark.read.parquet(f"{path}/manifest").first()
        except (PySparkException, Py4JJavaError):
            return "built"
        try:
            rows = self.spark.read.parquet(f"{path}/rows")
            n, content = table_hash(rows).first()
        except (PySparkException, Py4JJavaError):  # what can't be read is made again
            return "repaired"
        return "reused" if m is not None and (n, content, rows.schema.simpleString()) == (m["n"], m["content_hash"], m["schema"]) else "repaired"
