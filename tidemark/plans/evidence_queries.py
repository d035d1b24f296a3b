"""Streams, stores and logs that can be run again, each beside SQL over the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.registry import PANEL, query
from tidemark.sources import evidence
from tidemark.sources.panel import panel_week, read
from tidemark.sources.stages import shared_folder, written
from tidemark.sources.store import Store, digest
from tidemark.streaming import intake, revisions

DAY0 = "2024-01-01"
DELAY_DAYS, EXPIRY_DAYS = 3, 10


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/tidemark/{name}-{uuid.uuid4().hex}"


def _arrivals(spark: SparkSession, d: str) -> DataFrame:
    """Events as they come in by fortnights (b): some a fortnight late, some from before their time, some without a time of observation."""
    e, i = read(spark, d, "events"), F.col("event_id")
    ts = F.col("ts").cast("timestamp")
    b = F.floor(F.datediff(ts, F.lit(DAY0)) / 14) + F.when(i % 17 == 0, 1).otherwise(0)
    out = e.select("event_id", ts.alias("ts"), "value", b.cast("int").alias("b"))
    observed = F.when(i % 29 == 0, F.lit(None)).when(i % 23 == 0, F.col("ts") - F.expr("interval 1 day")).otherwise(F.lit(DAY0).cast("timestamp") + F.make_dt_interval(F.col("b") * 14 + 14))
    return out.withColumn("observed", observed)


_ARRIVALS = f"""a AS (SELECT event_id, ts, date_diff('day', DATE '{DAY0}', CAST(ts AS DATE)) // 14 + (event_id % 17 = 0)::INT AS b FROM events),
o AS (SELECT *, CASE WHEN event_id % 29 = 0 THEN NULL WHEN event_id % 23 = 0 THEN ts - INTERVAL 1 DAY ELSE TIMESTAMP '{DAY0}' + to_days(CAST(b * 14 + 14 AS INT)) END AS observed FROM a),
m AS (SELECT b, max(max(ts) FILTER (ts <= observed)) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM o GROUP BY b),
told AS (SELECT event_id, b AS batch, CASE WHEN ts IS NULL OR observed IS NULL THEN 'no_time' WHEN ts > observed THEN 'future' WHEN ts < mark - INTERVAL {DELAY_DAYS} DAY THEN 'late' END AS reason FROM o JOIN m USING (b))"""


def _take(spark: SparkSession, rows: DataFrame, key: str, each) -> None:
    """Write the rows of each value of a small integer key as files of their own, and call ``each`` with the folder and schema after each: one micro-batch."""
    home, schema = _folder(spark, "arrivals"), rows.drop(key).schema
    for k in sorted(r[key] for r in rows.select(key).distinct().collect()):  # a row per batch
        rows.where(F.col(key) == k).drop(key).write.parquet(f"{home}/{k}")
        each(f"{home}/*", schema)


def _intake(spark: SparkSession, d: str) -> tuple[intake.Intake, DataFrame]:
    arrivals = written(_arrivals(spark, d), "arrivals")
    taken = intake.Intake(_folder(spark, "intake"), "ts", intake.in_time("ts", "observed", DELAY_DAYS * 86_400))
    mark = _folder(spark, "progress")
    _take(spark, arrivals, "b", lambda home, schema: taken.run(spark.readStream.schema(schema).parquet(home), mark))
    return taken, arrivals


@query(f"WITH {_ARRIVALS} SELECT * FROM told")
def dead_letters(spark, d):
    """Every event of a stream in four micro-batches, accepted or kept with the reason why not."""
    taken, _ = _intake(spark, d)
    good = taken.accepted(spark).select("event_id", F.col("batch").cast("long").alias("batch"), F.lit(None).cast("string").alias("reason"))
    return good.unionByName(taken.rejected(spark).select("event_id", F.col("batch").cast("long").alias("batch"), "reason"))


@query(f"WITH {_ARRIVALS} SELECT batch, count(*) AS n_read, count(*) - count(reason) AS n_accepted, count(reason) AS n_rejected, 'identical' AS again FROM told GROUP BY batch")
def idempotent_batches(spark, d):
    """Receipts of the batches, and what taking each of them once more says."""
    taken, arrivals = _intake(spark, d)
    numbers = [r["b"] for r in arrivals.select("b").distinct().collect()]
    again = [(n, taken.take(arrivals.where(F.col("b") == n).drop("b"), n)) for n in numbers]
    return taken.receipts(spark).join(spark.createDataFrame(again, "batch long, again string"), "batch").select("batch", "n_read", "n_accepted", "n_rejected", "again")


@query(
    f"""WITH o AS (SELECT user_id || ':' || event_type AS id, date_diff('day', DATE '{DAY0}', CAST(ts AS DATE)) // 7 AS w, md5(CAST(count(*) % 3 AS VARCHAR)) AS h FROM events GROUP BY ALL),
s AS (SELECT *, sum((7 * (w - prev) > {EXPIRY_DAYS})::INT) OVER (PARTITION BY id ORDER BY w) AS life FROM (SELECT *, coalesce(lag(w) OVER (PARTITION BY id ORDER BY w), w) AS prev FROM o)),
f AS (SELECT *, first(h) OVER (PARTITION BY id, life ORDER BY w) AS fh, min(w) OVER (PARTITION BY id, life) AS fw, row_number() OVER (PARTITION BY id, life, h ORDER BY w) AS k FROM s)
SELECT id, CAST(DATE '{DAY0}' + to_days(CAST(7 * w AS INT)) AS DATE) AS observed, h AS content_hash, CASE WHEN w = fw THEN 'new' WHEN k > 1 THEN 'repeat_same' ELSE 'identity_hash_changed' END AS status,
 CAST(DATE '{DAY0}' + to_days(CAST(7 * fw AS INT)) AS DATE) AS first_seen, CAST(sum((k = 1 AND h <> fh)::INT) OVER (PARTITION BY id, life ORDER BY w) AS BIGINT) AS revisions FROM f"""
)
def revision_status(spark, d):
    """Weekly observations of each user's events of a type: new, repeated or revised, with state that expires after ten days."""
    ts = F.col("ts").cast("timestamp")
    rows = read(spark, d, "events").select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("id"), F.floor(F.datediff(ts, F.lit(DAY0)) / 7).cast("int").alias("w"))
    rows = written(rows.groupBy("id", "w").agg(F.md5((F.count("*") % 3).cast("string")).alias("content_hash")).withColumn("observed", F.lit(DAY0).cast("timestamp") + F.make_dt_interval(7 * F.col("w"))), "observations")
    ledger, mark = revisions.Ledger(_folder(spark, "statuses"), EXPIRY_DAYS * 86_400), _folder(spark, "progress")
    _take(spark, rows, "w", lambda home, schema: ledger.run(spark.readStream.schema(schema).parquet(home), mark))
    return ledger.told(spark).select("id", F.to_date("observed").alias("observed"), "content_hash", "status", F.to_date("first_seen").alias("first_seen"), "revisions")


@query(f"WITH {PANEL} SELECT CAST(year(date) AS VARCHAR) AS partition, entity, round(sum(amount), 2) AS amount, count(*) AS weeks, 'reused' AS state FROM panel GROUP BY ALL")
def cached_dataset(spark, d):
    """Yearly partitions of the panel, made once and read the second time."""
    panel = written(panel_week(spark, d).select("entity", "date", "amount"), "panel")
    store, inputs = Store(spark, _folder(spark, "store")), digest(panel)
    years = sorted(r["y"] for r in panel.select(F.year("date").alias("y")).distinct().collect())  # a row per year
    parts = {str(y): lambda y=y: panel.where(F.year("date") == y).groupBy("entity").agg(F.round(F.sum("amount"), 2).alias("amount"), F.count("*").alias("weeks")) for y in years}
    store.dataset("yearly", inputs, {"digits": 2}, parts)
    rows, states = store.dataset("yearly", inputs, {"digits": 2}, parts)
    return rows.join(spark.createDataFrame([*states.items()], "partition string, state string"), "partition").select("partition", "entity", "amount", "weeks", "state")


_HASHED = "sha256(concat_ws('|', CAST(sequence AS VARCHAR), previous_hash, body))"


@query(
    f"""WITH r AS (SELECT row_number() OVER (ORDER BY event_id) AS sequence, '{{"user_id":' || user_id || ',"event_type":"' || event_type || '"}}' AS body FROM events),
l AS (SELECT sequence, body, coalesce(sha256(lag(body) OVER (ORDER BY sequence)), 'GENESIS') AS previous_hash FROM r), h AS (SELECT *, {_HASHED} AS record_hash FROM l),
t AS (SELECT CASE WHEN sequence % 107 = 11 THEN sequence + 1 WHEN sequence % 107 = 12 THEN sequence - 1 ELSE sequence END AS sequence, CASE WHEN sequence % 97 = 5 THEN replace(body, 'user', 'usor') ELSE body END AS body, previous_hash, record_hash
 FROM (SELECT * FROM h UNION ALL SELECT * FROM h WHERE sequence % 103 = 9) WHERE sequence % 101 <> 7),
one AS (SELECT sequence, count(*) AS n, arg_min(body, record_hash || body) AS body FROM t GROUP BY 1), v AS (SELECT t.*, p.sequence IS NOT NULL AS follows, sha256(p.body) AS expected FROM t LEFT JOIN one p ON p.sequence = t.sequence - 1)
SELECT sequence, 'hash' AS fault FROM v WHERE record_hash <> {_HASHED} UNION SELECT sequence, 'previous_hash' FROM v WHERE CASE WHEN follows THEN previous_hash <> expected ELSE sequence = 1 AND previous_hash <> 'GENESIS' END
UNION SELECT sequence, 'missing' FROM v WHERE NOT follows AND sequence <> 1 UNION SELECT sequence, 'repeated' FROM one WHERE n > 1"""
)
def audit_chain(spark, d):
    """Faults of a linked log of all events in which records were changed, taken out, repeated and swapped."""
    log = evidence.link(read(spark, d, "events"), ["event_id"], ["user_id", "event_type"])
    s = F.col("sequence")
    bad = log.unionByName(log.where(s % 103 == 9)).where(s % 101 != 7)
    moved = F.when(s % 107 == 11, s + 1).when(s % 107 == 12, s - 1).otherwise(s)
    bad = bad.select(moved.alias("sequence"), F.when(s % 97 == 5, F.replace("body", F.lit("user"), F.lit("usor"))).otherwise(F.col("body")).alias("body"), "previous_hash", "record_hash")
    return evidence.verify_chain(bad)


@query(
    f"""WITH {PANEL}, r AS (SELECT sha256('{{"entity":' || entity || ',"date":"' || date || '","close":' || CAST(round(close, 9) AS DECIMAL(22, 9)) || '}}') AS h FROM panel),
s AS (SELECT count(*) AS n, {", ".join(f"CAST(sum(CAST('0x' || substr(h, {1 + 12 * i}, 12) AS BIGINT)) AS VARCHAR) AS s{i}" for i in range(4))} FROM r)
SELECT n, sha256(concat_ws('|', n, s0, s1, s2, s3)) AS content_hash FROM s"""
)
def canonical_hash(spark, d):
    """A hash of the weekly closes that doesn't depend on the order of rows."""
    return evidence.table_hash(panel_week(spark, d).select("entity", "date", F.round("close", 9).cast("decimal(22,9)").alias("close")))
