"""Write-once tables, content hashes and linked logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tidemark.sources.stages import numbered, written


def row_hash(df: DataFrame, columns: list[str] | None = None) -> Column:
    return F.sha2(F.to_json(F.struct(*(columns or df.columns)), {"ignoreNullFields": "false"}), 256)


def table_hash(df: DataFrame) -> DataFrame:
    """One row (n, content_hash) that doesn't depend on the order of rows: sums of four slices of the row hashes, hashed."""
    h = row_hash(df)
    part = lambda i: F.sum(F.conv(F.substring(h, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).cast("string")
    return df.agg(F.count("*").alias("n"), F.sha2(F.concat_ws("|", F.count("*").cast("string"), *(part(i) for i in range(4))), 256).alias("content_hash"))


RECEIPT = "n long, content_hash string, schema string"


def write_once(df: DataFrame, path: str) -> str:
    """'created', or 'identical' where the table is there with the same rows; a different one raises.

    A receipt (rows, content hash, schema) beside the table is written after it. A retry is compared with the receipt by one
    pass over its own rows; a table whose writer stopped before the receipt is compared itself and gets one.
    """
    spark, schema = df.sparkSession, df.schema.simpleString()
    seen = (*table_hash(df).first(), schema)
    old = receipt(spark, path)
    if old is None:
        try:
            there = spark.read.parquet(path)
        except AnalysisException:
            df.write.mode("errorifexists").parquet(path)
            _sign(spark, path, seen)
            return "created"
        old = (*table_hash(there).first(), there.schema.simpleString())
        if old == seen:
            _sign(spark, path, seen)
    if old != seen:
        raise ValueError(f"{path} exists with other content")
    return "identical"


def receipt(spark: SparkSession, path: str) -> tuple | None:
    """What the receipt of a table that was written once says."""
    try:
        return tuple(spark.read.schema(RECEIPT).parquet(f"{path}.receipt").first())
    except AnalysisException:
        return None


def verify_once(spark: SparkSession, path: str) -> bool:
    """Whether a table that was written once still has the rows of its receipt."""
    there = spark.read.parquet(path)
    return receipt(spark, path) == (*table_hash(there).first(), there.schema.simpleString())


def _sign(spark: SparkSession, path: str, seen: tuple) -> None:
    spark.createDataFrame([seen], RECEIPT).coalesce(1).write.mode("errorifexists").parquet(f"{path}.receipt")  # one row


#: Records per digest of a range, and what the first record follows.
RANGE, GENESIS = 1024, "GENESIS"


def link(records: DataFrame, order: list[str], payload: list[str]) -> DataFrame:
    """sequence (from 1), body, previous_hash and record_hash: a record's hash covers its sequence, its body and the digest of the body before it.

    Numbers come from ranges' counts and the body before from a join on sequence + 1, so nothing is ordered in one task.
    """
    rows = numbered(records.select(*order, F.to_json(F.struct(*payload)).alias("body")), list(order), "sequence")
    rows = written(rows.select((F.col("sequence") + 1).alias("sequence"), "body"), "audit-log")
    before = rows.select((F.col("sequence") + 1).alias("sequence"), F.sha2("body", 256).alias("previous_hash"))
    linked = rows.join(before, "sequence", "left").withColumn("previous_hash", F.coalesce("previous_hash", F.lit(GENESIS)))
    return linked.select("sequence", "body", "previous_hash", record_hash().alias("record_hash"))


def record_hash() -> Column:
    return F.sha2(F.concat_ws("|", F.col("sequence").cast("string"), "previous_hash", "body"), 256)


def verify_chain(log: DataFrame) -> DataFrame:
    """sequence and fault of each record of a log that is not as it was linked: hash (changed), previous_hash (doesn't follow the record before), repeated, and missing (the record before isn't there)."""
    one = log.groupBy("sequence").agg(F.count("*").alias("n"), F.min(F.struct("record_hash", "body")).alias("r"))
    before = one.select((F.col("sequence") + 1).alias("sequence"), F.sha2("r.body", 256).alias("expected"))
    both = log.join(before, "sequence", "left")
    first = F.col("sequence") == 1
    faults = F.array_compact(
        F.array(
            F.when(~F.col("record_hash").eqNullSafe(record_hash()), "hash"),
            F.when(F.col("expected").isNotNull() & ~F.col("previous_hash").eqNullSafe(F.col("expected")) | first & ~F.col("previous_hash").eqNullSafe(F.lit(GENESIS)), "previous_hash"),
            F.when(F.col("expected").isNull() & ~first, "missing"),
        )
    )
    found = both.select("sequence", F.explode(faults).alias("fault")).unionByName(one.where("n > 1").select("sequence", F.lit("repeated").alias("fault")))
    return found.distinct()


def range_digests(log: DataFrame) -> DataFrame:
    """level, place, n, digest: a hash per RANGE consecutive records, per RANGE of those, and so on up to one that seals the log."""
    level, out = 0, None
    rows = log.select("sequence", F.col("record_hash").alias("digest"), F.lit(1).cast("long").alias("n"))
    at = F.floor((F.col("sequence") - 1) / RANGE).cast("long")
    while True:
        rows = rows.groupBy(at.alias("place")).agg(F.sum("n").alias("n"), F.sha2(F.concat_ws("|", F.transform(F.array_sort(F.collect_list(F.struct("sequence", "digest"))), lambda x: x["digest"])), 256).alias("digest"))
        rows = written(rows.select(F.lit(level).alias("level"), "place", "n", "digest"), f"digests-{level}")
        out = rows if out is None else out.unionByName(rows)
        if rows.limit(2).count() < 2:
            return out
        level, rows = level + 1, rows.select((F.col("place") + 1).alias("sequence"), "digest", "n")


def latest_file(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """Rows of many files with the file each came from."""
    return spark.read.option("pathGlobFilter", glob).option("header", True).csv(path).withColumn("file", F.input_file_name())
