"""License scans: canonical digest lookup.

An entire text is normalised (case, copyright lines, punctuation and white space, equivalent
spellings, the names of holders that licences of the BSD family have in their clauses) and its SHA-256 joined to the digests of known licence texts. Its parts, single lines and
the blocks between rules of dashes, stars and the like, are joined to the same table, which has short
texts such as one-line notices and SPDX tags besides licences. Built-in functions only; the known table
is broadcast if its size, which is looked at, allows, and else joined by shuffle.

Edge cases: a null text counts as empty, whose digest matches nothing; equal texts match alike and
repeated rows stay rows of their own; texts of any length are read whole; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import text_or_empty
from tidemark.llm.license_texts import DIGESTS, NOTICES, SLOT_WORD, SLOTS, SPELLINGS, TEXTS

COPYRIGHT_LINE = r"^[^\p{L}\p{N}©(]*(?:(?:portions[ \t]+)?copyright[ \t]*(?:\(c\)|©|[0-9]{4}|<|\[|by )|\(c\)[ \t]|©|all[ \t]+rights[ \t]+reserved[^\p{L}\p{N}]*$)"
#: A line of signs alone, between two blocks.
RULE = r"\r?\n[ \t]*[-=*#_~]{3,}[ \t]*\r?\n"
#: Known tables of at most so many rows may be broadcast.
BROADCAST_ROWS = 10_000


def plain(text: Column) -> Column:
    """Lower case, one blank for whatever isn't a letter or digit, one spelling for equivalent words, and one holder where a licence names its own."""
    out = F.concat(F.lit(" "), F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    for written, read in SPELLINGS:
        out = F.replace(out, F.lit(f" {written} "), F.lit(f" {read} "))
    # The array makes the text be put together once, not wherever it is named.
    return F.trim(F.get(F.transform(F.array(out), _one_holder), F.lit(0)))


def _one_holder(text: Column) -> Column:
    out = text
    for slot, read in SLOTS:
        out = F.regexp_replace(out, slot, read)
    return F.when(F.contains(text, F.lit(SLOT_WORD)), out).otherwise(text)


def canonical(lowered: Column) -> Column:
    lines = F.filter(F.split(lowered, r"\r?\n"), lambda x: ~F.rlike(x, F.lit(COPYRIGHT_LINE)))
    return plain(F.array_join(lines, " "))


def known_texts(spark: SparkSession, texts: list[tuple[str, str]] | None = None, notices: list[tuple[str, str]] | None = None) -> DataFrame:
    """license_id and canonical digest of licences, with and without the title line, and of notices."""
    rows = [(k, v) for k, t in (TEXTS if texts is None else texts) for v in (t, t.partition("\n\n")[2]) if v]
    raw = spark.createDataFrame(rows, "license_id string, text string").select("license_id", canonical(F.lower("text")).alias("text"))
    short = spark.createDataFrame(NOTICES if notices is None else notices, "license_id string, text string").select("license_id", plain(F.lower("text")).alias("text"))
    known = raw.unionByName(short).select("license_id", F.sha2("text", 256).alias("known_digest"))
    if texts is None:
        known = known.unionByName(spark.createDataFrame(DIGESTS, "license_id string, known_digest string"))
    return known.groupBy("known_digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, digest, license_id of the entire text (or null) and part_ids, the licences that its lines and blocks are texts or notices of."""
    known = known_texts(docs.sparkSession) if known is None else known.groupBy("known_digest").agg(F.min("license_id").alias("license_id"))
    if known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.lower(text_or_empty()).alias("text"))
    lines = F.transform(F.split("text", r"\r?\n"), plain)
    blocks = F.split("text", RULE)
    blocks = F.when(F.size(blocks) > 1, F.transform(blocks, canonical)).otherwise(F.array().cast("array<string>"))
    parts = F.array_remove(F.array_distinct(F.concat(lines, blocks)), "")
    digested = rows.select("row", "doc_id", F.sha2(canonical(F.col("text")), 256).alias("digest"), F.transform(parts, lambda x: F.sha2(x, 256)).alias("parts"))
    # The entire text first, at place 0, then its parts; all of a row's are in one task, so little is left of them when they are grouped.
    own = digested.select("row", "doc_id", "digest", F.posexplode(F.concat(F.array("digest"), F.col("parts"))).alias("place", "known_digest"))
    met = own.join(known, "known_digest", "left")
    found = met.groupBy("row", "doc_id", "digest").agg(
        F.min(F.when(F.col("place") == 0, F.col("license_id"))).alias("license_id"),
        F.concat_ws(",", F.array_sort(F.collect_set(F.when(F.col("place") > 0, F.col("license_id"))))).alias("part_ids"),
    )
    return found.select("doc_id", "digest", "license_id", "part_ids")
