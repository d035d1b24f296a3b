"""Repeats and revisions of observations by identity, with state that expires.

State per identity is its first content and times, and a list of the contents that changed it (the quarantine). An
event-time timer clears an identity that hasn't been observed for ``expiry`` seconds; one that comes back later
is new, whether the timer has fired yet or not. Rows are taken one by one, in the order of their batches.

``classify`` keeps the state in a processor of its own, which is asked several times a row; ``Ledger`` does the same for whole
batches by windows and a join with a table of the identities that are alive, which each batch writes anew.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STATUS = "id string, observed timestamp, content_hash string, status string, first_seen timestamp, revisions long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Revisions(StatefulProcessor):
    def __init__(self, expiry: int):
        self.expiry = 1000 * expiry

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", "content_hash string, first_seen timestamp, last long")
        self.quarantine = handle.getListState("quarantine", "content_hash string, at long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        for r in rows:
            content, seen, last = self.first.get() if self.first.exists() else (None, None, None)
            if last is not None and r.at - last > self.expiry:
                self._forget()
                content = None
            changed = [c for c, _ in self.quarantine.get()] if content is not None and self.quarantine.exists() else []
            if content is None:
                content, seen, last, status = r.content_hash, r.observed, r.at, "new"
            elif r.content_hash == content or r.content_hash in changed:
                status = "repeat_same"
            else:
                status = "identity_hash_changed"
                self.quarantine.appendValue((r.content_hash, r.at))
                changed.append(r.content_hash)
            last = max(last, r.at)
            self.first.update((content, seen, last))
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(last + self.expiry)
            yield Row(id=key[0], observed=r.observed, content_hash=r.content_hash, status=status, first_seen=seen, revisions=len(changed))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        self._forget()
        return iter(())

    def _forget(self) -> None:
        self.first.clear()
        self.quarantine.clear()

    def close(self) -> None:
        pass


def session(spark: SparkSession) -> SparkSession:
    """A session for streams with this state: it needs a store of its own kind."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    for c in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(c, spark.conf.get(c))
    return own


def classify(stream: DataFrame, expiry: int, delay: str = "0 seconds") -> DataFrame:
    """Each row of (id string, observed, content_hash) as new, repeat_same or identity_hash_changed, with the first time of its identity and the number of its revisions so far."""
    rows = stream.select("id", "observed", "content_hash", F.unix_millis("observed").alias("at")).withWatermark("observed", delay)
    return rows.groupBy("id").transformWithState(Revisions(expiry), STATUS, "Append", "EventTime")


#: An identity that is alive: its first content and time, its latest time, and the contents that changed it (in structs, which can hold a null).
KNOWN = "id string, known_hash string, known_seen timestamp, known_last long, known_changed array<struct<content_hash:string>>"


@dataclass(frozen=True)
class Ledger:
    """root: folder of the tables told and known, a folder per batch in each; expiry: seconds.

    A batch's rows of one identity are taken in the order of their times, then contents. What a batch writes follows from its rows and what
    the one before it left, so a batch that is taken again overwrites its folders with the same rows. An identity is forgotten
    once a row was observed more than ``expiry`` later; late rows are taken, too, as of a new identity if theirs has been forgotten.
    """

    root: str
    expiry: int

    def take(self, batch: DataFrame, number: int) -> None:
        spark, most = batch.sparkSession, 1000 * self.expiry
        known = spark.read.schema(KNOWN).parquet(self._folder("known", number - 1)) if number else spark.createDataFrame([], KNOWN)
        rows = batch.select("id", "observed", "content_hash", F.unix_millis("observed").alias("at"), F.lit(True).alias("came"))
        rows = rows.join(known.withColumnRenamed("id", "known_id"), F.col("id").eqNullSafe(F.col("known_id")), "full").withColumn("id", F.when(F.col("came"), F.col("id")).otherwise(F.col("known_id"))).drop("known_id")
        own = Window.partitionBy("id").orderBy("at", "content_hash")
        last = F.greatest(F.lag("at").over(own), "known_last")
        rows = rows.withColumn("new", F.col("came") & (last.isNull() | (F.col("at") - last > most)))
        rows = rows.withColumn("life", F.sum(F.coalesce(F.col("new"), F.lit(False)).cast("int")).over(own.rowsBetween(Window.unboundedPreceding, 0)))  # 0: the known one goes on
        life, old = Window.partitionBy("id", "life").orderBy("at", "content_hash"), F.col("life") == 0
        before = F.exists("known_changed", lambda x: x["content_hash"].eqNullSafe(F.col("content_hash")))
        rows = rows.withColumns({
            "first_hash": F.when(old, F.col("known_hash")).otherwise(F.first("content_hash").over(life)), "first_seen": F.when(old, F.col("known_seen")).otherwise(F.first("observed").over(life)),
            "again": F.row_number().over(Window.partitionBy("id", "life", "content_hash").orderBy("at")) > 1, "latest": F.max("life").over(Window.partitionBy("id")),
        })
        same = F.col("content_hash").eqNullSafe(F.col("first_hash")) | F.col("again") | (old & before)
        rows = rows.withColumn("status", F.when(F.col("came"), F.when(F.col("new"), F.lit("new")).when(same, F.lit("repeat_same")).otherwise(F.lit("identity_hash_changed"))))
        changed = F.col("status") == "identity_hash_changed"
        since = F.sum(F.coalesce(changed, F.lit(False)).cast("long")).over(life.rowsBetween(Window.unboundedPreceding, 0))
        rows = rows.withColumn("revisions", F.when(old, F.size("known_changed")).otherwise(0) + since)
        rows.write.mode("overwrite").parquet(self._folder("told", number))
        rows = spark.read.schema(rows.schema).parquet(self._folder("told", number))
        alive = rows.where("life = latest").groupBy("id").agg(
            F.first("first_hash").alias("known_hash"), F.first("first_seen").alias("known_seen"), F.max(F.greatest("at", "known_last")).alias("known_last"),
            F.concat(F.first(F.when(old, F.col("known_changed")).otherwise(F.array().cast("array<struct<content_hash:string>>"))), F.collect_list(F.when(changed, F.struct("content_hash")))).alias("known_changed"),
        )
        mark = rows.agg(F.max(F.greatest("at", "known_last")).alias("mark"))  # one row
        alive.crossJoin(F.broadcast(mark)).where(F.col("mark") - F.col("known_last") <= most).drop("mark").write.mode("overwrite").parquet(self._folder("known", number))

    def run(self, stream: DataFrame, checkpoint: str) -> None:
        """Take all that has arrived."""
        self_, query = self, stream.writeStream.foreachBatch(lambda rows, number: self_.take(rows, number))
        query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    def told(self, spark: SparkSession) -> DataFrame:
        """The rows of all batches, as ``classify`` gives them."""
        return spark.read.parquet(f"{self.root}/told/number=*").where("came").select(*(f.split()[0] for f in STATUS.split(", ")))

    def _folder(self, name: str, number: int) -> str:
        return f"{self.root}/{name}/number={number}"
