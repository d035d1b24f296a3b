"""Queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import alignment, chat, jaccard, license, license_texts, media, mixing, negatives, packing, pii, prefixhash, quality, sharding, topk
from tidemark.llm.common import documents

#: Parameters: the tokenizer's file, and the key of the pseudonyms (a deployment passes its own).
TOKENIZER = "word_bpe_49k.json"
ALIGNED = ("byte_bpe_50k.json", "piece_bpe_32k.model")
PII_KEY = b"example key, replace in deployment"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = media.read_media(media.text_media(documents(spark, sf_dir)))
    return read.select("doc_id", "n_bytes", *(x.split()[0] for x in media.READ.split(", ")))


#: The mixture: flatter languages and sources, topics as they are nearly; half of all tokens.
MIX_POWERS = {"source": 0.7, "lang": 0.8, "topic": 0.9}
MIX_FRACTION = 0.5


def mix_dimensions() -> dict[str, Column]:
    return {"source": F.col("source"), "lang": F.col("lang"), "topic": mixing.topic()}


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", "text", "lang", "source")
    return mixing.sample_probabilities(rows, mix_dimensions(), MIX_POWERS, MIX_FRACTION).select("doc_id", "mix.*")


def op3_prefix_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixhash.compare_edited(documents(spark, sf_dir))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.classify(documents(spark, sf_dir), labels, ["doc_id", "lang", "text"]).drop("text")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op7_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(documents(spark, sf_dir))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(documents(spark, sf_dir))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pii.pseudonymize(documents(spark, sf_dir), PII_KEY)
    return done.select("doc_id", "text", F.size("found").alias("n_found"), "found")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path())


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, label = embeddings(spark, sf_dir), F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return negatives.mine(e.select(F.col("vec_id").alias("id"), moved.alias("label"), F.col("embedding").alias("vector")), F.col("id") % 100 == 0)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(documents(spark, sf_dir), *map(tokenizer_path, ALIGNED))


def op13_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(embeddings(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), F.col("id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media": op1_media,
    "op2_mixing": op2_mixing,
    "op3_prefix_hash": op3_prefix_hash,
    "op4_quality": op4_quality,
    "op5_sharding": op5_sharding,
    "op6_chat": op6_chat,
    "op7_license": op7_license,
    "op8_jaccard": op8_jaccard,
    "op9_pii": op9_pii,
    "op10_packing": op10_packing,
    "op11_negatives": op11_negatives,
    "op12_alignment": op12_alignment,
    "op13_topk": op13_topk,
}


def _vectors_sql(scale: int) -> str:
    return f"""vectors AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS moved, [floor({scale} * CAST(x AS DOUBLE)) FOR x IN embedding]::DOUBLE[] AS v FROM embeddings
 WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""


NEGATIVES_SQL = f"""WITH {_vectors_sql(256)}, s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.moved = b.moved AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
 FROM vectors a JOIN vectors b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND a.moved IS NOT NULL AND b.moved IS NOT NULL),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM s WHERE same QUALIFY r <= 5)
SELECT anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS INT) AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
 FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score QUALIFY rank <= 10"""
TOPK_SQL = f"""WITH {_vectors_sql(1024)}, s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM vectors a JOIN vectors b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s QUALIFY rank <= 10"""

CHAT_SQL = """WITH own AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), 'row ' || row_number() OVER ()) AS conv FROM conversations),
t AS (SELECT conv_id, conv, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv ORDER BY coalesce(turn, -1), coalesce(role, ''), md5(coalesce(text, ''))) AS pos FROM own),
c AS (SELECT min(conv_id) AS conv_id, conv, count(*) AS n_turns, list([role, text] ORDER BY pos) AS l, string_agg('<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10), '' ORDER BY pos) AS rendered FROM t GROUP BY conv),
p AS (SELECT DISTINCT a.conv FROM c a JOIN c b ON a.l[1] = b.l[1] AND b.n_turns > a.n_turns AND b.l[1:a.n_turns] = a.l)
SELECT min(conv_id) AS conv_id, n_turns, count(*) AS n_logged, rendered FROM c WHERE conv NOT IN (SELECT conv FROM p) GROUP BY n_turns, l, rendered"""


def license_sql() -> str:
    """The licence scan in DuckDB's words, over the same fixed texts and spellings."""

    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    def plain(x: str) -> str:
        out = rf"' ' || trim(regexp_replace({x}, '[^\p{{L}}\p{{N}}]+', ' ', 'g')) || ' '"
        for written, read in license_texts.SPELLINGS:
            out = f"replace({out}, ' {written} ', ' {read} ')"
        for slot, read in license_texts.SLOTS:
            out = f"regexp_replace({out}, {quoted(slot)}, {quoted(read)}, 'g')"
        return f"trim({out})"

    def canonical(x: str) -> str:
        lines = rf"regexp_split_to_array({x}, '\r?\n')"
        kept = f"list_filter({lines}, lambda x: NOT regexp_matches(x, {quoted(license.COPYRIGHT_LINE)}))"
        return plain(f"array_to_string({kept}, ' ')")

    texts = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, t in license_texts.TEXTS for v in (t, t.partition("\n\n")[2]))
    notices = ", ".join(f"({quoted(k)}, {quoted(t)})" for k, t in license_texts.NOTICES)
    digests = ", ".join(f"({quoted(k)}, {quoted(t)})" for k, t in license_texts.DIGESTS)
    return f"""WITH known AS (SELECT digest, min(k) AS license_id FROM (SELECT k, sha256({canonical("lower(t)")}) AS digest FROM (VALUES {texts}) v(k, t)
 UNION ALL SELECT k, sha256({plain("lower(t)")}) FROM (VALUES {notices}) v(k, t) UNION ALL SELECT k, t FROM (VALUES {digests}) v(k, t)) GROUP BY 1),
whole AS (SELECT row_number() OVER () AS n, doc_id, lower(coalesce(text, '')) AS text FROM documents),
parts AS (SELECT n, {plain("x")} AS own FROM (SELECT n, unnest(regexp_split_to_array(text, '\r?\n')) AS x FROM whole)
 UNION ALL SELECT n, {canonical("x")} FROM (SELECT n, unnest(b) AS x FROM (SELECT n, regexp_split_to_array(text, {quoted(license.RULE)}) AS b FROM whole) WHERE len(b) > 1)),
named AS (SELECT n, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS part_ids FROM parts JOIN known ON known.digest = sha256(own) GROUP BY 1),
docs AS (SELECT n, doc_id, sha256({canonical("text")}) AS digest FROM whole)
SELECT doc_id, digest, license_id, coalesce(part_ids, '') AS part_ids FROM docs LEFT JOIN known USING (digest) LEFT JOIN named USING (n)"""


#: The other operators hash, decode, tokenise, permute or iterate beyond what SQL can say.
ORACLES: dict[str, str] = {"op6_chat": CHAT_SQL, "op7_license": license_sql(), "op11_negatives": NEGATIVES_SQL, "op13_topk": TOPK_SQL}
