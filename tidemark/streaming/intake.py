"""Taking in batches of observations once: accepted rows, dead letters with a reason, and a receipt per batch.

A batch's rows are written first and its receipt last. Readers see only batches that have one, so a crash
between the two leaves nothing half taken: the replayed batch overwrites its own folders. A batch that comes again with
the same rows is recognised by its content hash and does nothing; one that comes with other rows raises an error.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tidemark.sources.evidence import table_hash

RECEIPT = "batch long, content_hash string, n_read long, n_accepted long, n_rejected long, mark timestamp"


@dataclass(frozen=True)
class Intake:
    """root: folder of the tables accepted, rejected and receipts. judge: (rows, receipts) -> rows with ``reason``, null where accepted; time: the column whose latest accepted value is a receipt's mark."""

    root: str
    time: str
    judge: Callable[[DataFrame, DataFrame], DataFrame]

    def take(self, batch: DataFrame, number: int) -> str:
        """'taken', or 'identical' where the batch was taken before."""
        spark = batch.sparkSession
        rows = batch.persist()
        try:
            seen = table_hash(rows).first()
            done = self.receipts(spark)
            if old := done.where(F.col("batch") == number).first():
                if old["content_hash"] != seen["content_hash"]:
                    raise ValueError(f"batch {number} was taken with other rows")
                return "identical"
            told = self.judge(rows, done)
            for name, part in (("accepted", F.col("reason").isNull()), ("rejected", F.col("reason").isNotNull())):
                told.where(part).write.mode("overwrite").parquet(self._folder(name, number))
            taken, refused = (spark.read.parquet(self._folder(n, number)) for n in ("accepted", "rejected"))
            sums = taken.agg(F.count("*").alias("n_accepted"), F.max(self.time).cast("timestamp").alias("mark")).crossJoin(refused.agg(F.count("*").alias("n_rejected")))  # one row each
            self.commit(sums.select(F.lit(number).cast("long").alias("batch"), F.lit(seen["content_hash"]).alias("content_hash"), F.lit(seen["n"]).cast("long").alias("n_read"), "n_accepted", "n_rejected", "mark"), number)
            return "taken"
        finally:
            rows.unpersist()

    def commit(self, receipt: DataFrame, number: int) -> None:
        receipt.coalesce(1).write.mode("overwrite").parquet(self._folder("receipts", number))  # one row

    def run(self, stream: DataFrame, checkpoint: str) -> None:
        """Take all that has arrived."""
        self_, query = self, stream.writeStream.foreachBatch(lambda rows, number: self_.take(rows, number) and None)
        query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    def receipts(self, spark: SparkSession) -> DataFrame:
        try:
            return spark.read.parquet(f"{self.root}/receipts/number=*").select(*(f.split()[0] for f in RECEIPT.split(", ")))
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            return spark.createDataFrame([], RECEIPT)

    def accepted(self, spark: SparkSession) -> DataFrame:
        return self._of(spark, "accepted").drop("reason")

    def rejected(self, spark: SparkSession) -> DataFrame:
        """The dead letters, with their reason."""
        return self._of(spark, "rejected")

    def _of(self, spark: SparkSession, name: str) -> DataFrame:
        numbers = sorted(r["batch"] for r in self.receipts(spark).select("batch").collect())  # a row per batch
        if not numbers:
            raise ValueError("no batch has been taken")
        return spark.read.option("basePath", f"{self.root}/{name}").option("mergeSchema", True).parquet(*(self._folder(name, n) for n in numbers)).withColumnRenamed("number", "batch")

    def _folder(self, name: str, number: int) -> str:
        return f"{self.root}/{name}/number={number}"


def first_of(checks: dict[str, Column]) -> Column:
    """The name of the first check that fails (null counts as failing), null where all hold."""
    return F.coalesce(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()), F.lit(None).cast("string"))


def in_time(time: str, observed: str, delay_seconds: int) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Rows need a time that is not after their observation, nor further than the delay behind the latest time accepted in earlier batches."""

    def judge(rows: DataFrame, receipts: DataFrame) -> DataFrame:
        mark = receipts.agg(F.max("mark").alias("__mark"))  # one row
        oldest = F.col("__mark") - F.make_dt_interval(secs=F.lit(delay_seconds))
        checks = {"no_time": F.col(time).isNotNull() & F.col(observed).isNotNull(), "future": F.col(time) <= F.col(observed), "late": F.col("__mark").isNull() | (F.col(time) >= oldest)}
        return rows.crossJoin(F.broadcast(mark)).withColumn("reason", first_of(checks)).drop("__mark")

    return judge


def new_days(date: str, accepted: Callable[[SparkSession], DataFrame]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Rows of a day that an earlier batch brought are dead letters: a day is appended once."""

    def judge(rows: DataFrame, receipts: DataFrame) -> DataFrame:
        if receipts.isEmpty():
            return rows.withColumn("reason", first_of({"no_day": F.col(date).isNotNull()}))
        known = accepted(rows.sparkSession).select(F.col(date).alias("__day")).distinct().withColumn("__known", F.lit(True))
        both = rows.join(F.broadcast(known), F.col(date) == F.col("__day"), "left")  # a row per day
        return both.withColumn("reason", first_of({"no_day": F.col(date).isNotNull(), "known_day": F.col("__known").isNull()})).drop("__day", "__known")

    return judge


def daily(root: str, date: str) -> Intake:
    """An intake that appends each new day once."""
    intake: Intake = Intake(root, date, new_days(date, lambda spark: intake.accepted(spark)))
    return intake
