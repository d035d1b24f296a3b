"""Chat formatting: cumulative-snapshot collapse.

A logged conversation that is a proper prefix of a longer one is a snapshot of it. Every turn gets a
hash salted with its place; the running xor of these hashes (two independent 64-bit ones) names the
prefix that ends there. A conversation whose full hash is a proper prefix of another, or equal to that
of one with a lower id, goes by anti-join; the others are rendered.

Turns are ordered by (turn, role, MD5 of the text); running values are taken in two levels (blocks of turns,
then blocks), and each level is dealt by conversation and block, so a conversation of any length is spread. A block
with more rows than usual (turns of equal or without number) is cut again by turn, role and the digest's first two bytes.
Prefixes are written once, without texts; texts are read again for the conversations that stay.

Edge cases: null roles and texts count as empty; a row without a conv_id belongs to no other and is a conversation of
one turn (equal ones are one, added up before they are shuffled); a null turn comes first; rows repeated exactly are turns
like any other, and so are turns of equal number; an empty table gives no conversations; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, small

BLOCK = 256
#: Rows from which a block is cut again, and up to how many such blocks are broadcast (counted first).
FULL, BROADCAST_BLOCKS = 4096, 100_000


def _order(conversations: DataFrame) -> DataFrame:
    """conv, turn, role, text and the digest of the text: what turns are ordered by is turn, role, digest."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv"),
        F.coalesce(F.col("turn").cast("long"), F.lit(-1).cast("long")).alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        text.alias("text"),
        F.unhex(F.md5(text)).alias("digest"),
    )


def _salts() -> list[Column]:
    """The two hashes of a turn, before its place."""
    return [F.xxhash64("role", "digest").alias("h"), F.xxhash64(F.lit(7), "digest", "role").alias("g")]


def _placed() -> list[Column]:
    return [F.xxhash64("at", "h"), F.xxhash64("g", "at")]


def prefixes(conversations: DataFrame, block: int = BLOCK, full: int = FULL) -> DataFrame:
    """conv, at (place from 1), n (turns of the conversation) and the two hashes of the prefix up to and with this turn. Texts go as digests; rows without a conv_id are left out."""
    rows = _order(conversations).where("conv is not null").drop("text").withColumn("block", F.floor(F.col("turn") / block))
    heavy = rows.groupBy("conv", "block").count().where(F.col("count") > full).select(F.col("conv").alias("c"), F.col("block").alias("b"))
    heavy = small(materialize(heavy, "chat-heavy"), BROADCAST_BLOCKS)
    rows = rows.join(heavy, (F.col("conv") == F.col("c")) & (F.col("block") == F.col("b")), "left")
    part = F.when(F.col("c").isNotNull(), F.struct("turn", "role", F.substring("digest", 1, 2).alias("head")))
    rows = rows.withColumn("block", F.struct(F.col("block").alias("of"), part.alias("part"))).drop("c", "b")
    own = Window.partitionBy("conv", "block").orderBy("turn", "role", "digest")
    placed = materialize(rows.withColumn("local", F.row_number().over(own)).select("conv", "block", "local", *_salts()), "chat-turns")
    # Places and running hashes within a block; the blocks before it add theirs.
    blocks = placed.groupBy("conv", "block").agg(F.count("*").alias("m"))
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = blocks.select(F.col("conv").alias("c"), F.col("block").alias("b"), F.coalesce(F.sum("m").over(before), F.lit(0)).alias("base"))
    same = (F.col("conv") == F.col("c")) & F.col("block").eqNullSafe(F.col("b"))
    at = placed.join(bases, same, "left").select("conv", "block", (F.col("base") + F.col("local")).alias("at"), "h", "g")
    hashed = materialize(at.withColumns(dict(zip(("h1", "h2"), _placed(), strict=True))).drop("h", "g"), "chat-hashes")
    sums = hashed.groupBy("conv", "block").agg(F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"), F.max("at").alias("last"))
    heads = sums.select(
        F.col("conv").alias("c"),
        F.col("block").alias("b"),
        F.max("last").over(Window.partitionBy("conv")).alias("n"),
        *(F.coalesce(F.bit_xor(x).over(before), F.lit(0)).alias(y) for x, y in (("x1", "o1"), ("x2", "o2"))),
    )
    upto = Window.partitionBy("conv", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return (
        hashed.withColumns({"r1": F.bit_xor("h1").over(upto), "r2": F.bit_xor("h2").over(upto)})
        .join(heads, same, "left")
        .select("conv", "at", "n", F.col("r1").bitwiseXOR(F.col("o1")).alias("p1"), F.col("r2").bitwiseXOR(F.col("o2")).alias("p2"))
    )


def render(role: Column, text: Column) -> Column:
    """One turn in the chat template."""
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("\n<|end|>\n"))


def collapse(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_logged (equal conversations) and the rendered text of each maximal conversation."""
    known = materialize(prefixes(conversations), "chat-prefixes")
    lone = _order(conversations).where("conv is null").groupBy("role", "digest").agg(F.count("*").alias("n_logged"))
    lone = lone.select("role", "digest", "n_logged", F.lit(1).cast("long").alias("at"), *_salts()).withColumns(dict(zip(("p1", "p2"), _placed(), strict=True)))
    whole = known.where("at = n").select("conv", "at", "p1", "p2", F.lit(1).cast("long").alias("m"), F.lit(None).cast("struct<role:string,digest:binary>").alias("turn"))
    whole = whole.unionByName(lone.select(F.lit(None).cast("long").alias("conv"), "at", "p1", "p2", F.col("n_logged").alias("m"), F.struct("role", "digest").alias("turn")))
    distinct = whole.groupBy("at", "p1", "p2").agg(F.min("conv").alias("conv"), F.sum("m").alias("n_logged"), F.max("turn").alias("turn"))
    # A prefix is proper where its conversation goes on; every prefix once, however many share it.
    inner = known.where("at < n").select("at", "p1", "p2").distinct()
    kept = materialize(distinct.join(inner, ["at", "p1", "p2"], "left_anti"), "chat-kept")
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "digest", "text")))
    numbered = (
        _order(conversations)
        .join(kept.select(F.col("conv").alias("c")), F.col("conv") == F.col("c"), "left_semi")
        .groupBy("conv")
        .agg(F.array_join(F.transform(turns, lambda t: render(t["role"], t["text"])), "").alias("rendered"))
    )
    result = [F.col("at").alias("n_turns"), "n_logged", "rendered"]
    named = kept.join(numbered, "conv").select(F.col("conv").alias("conv_id"), *result)
    single = kept.where("conv is null").select("at", "n_logged", F.col("turn.role").alias("role"), F.col("turn.digest").alias("digest"))
    texts = _order(conversations).where("conv is null").groupBy("role", "digest").agg(F.min("text").alias("text"))
    rest = single.join(texts, ["role", "digest"]).withColumn("rendered", render(F.col("role"), F.col("text")))
    return named.unionByName(rest.select(F.lit(None).cast("long").alias("conv_id"), *result))
