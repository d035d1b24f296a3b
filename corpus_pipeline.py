"""The corpus pipeline: quality classifier, near duplicates, pseudonyms, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each one as Parquet to
the shared folder and reads it again as the next one's docs. A class of near duplicates goes on as one row;
rows of different texts stay, whether their doc_ids are null, equal or neither.

Edge cases: null and empty texts have no perplexity, so the first stage rejects them, and an empty table gives empty
tables; null languages and sources count as '' where they matter and stay null in the rows; rows equal in every column
are one after the second stage; columns beyond those of documents are dropped at the first stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import jaccard, mixing, packing, pii, quality
from tidemark.llm.common import DOC_COLUMNS, documents, materialize
from tidemark.llm.queries import MIX_POWERS, PII_KEY, mix_dimensions, tokenizer_path

#: Expected share of the tokens that the mixture keeps, as far as probabilities of at most one allow.
FRACTION = 0.9


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.classify(docs, labels, list(DOC_COLUMNS)).where("keep").select(*DOC_COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id (nulls last) of each class of near duplicates."""
    return jaccard.one_per_class(docs, list(DOC_COLUMNS))


def pseudonymous(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms; n_chars follows the text."""
    done = pii.pseudonymize(docs, PII_KEY, DOC_COLUMNS)
    return done.withColumn("n_chars", F.when(F.size("found") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*DOC_COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to the target marginals."""
    mixed = mixing.sample_probabilities(docs.select(*DOC_COLUMNS), mix_dimensions(), MIX_POWERS, FRACTION)
    return mixed.where("mix.sampled").select(*DOC_COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boundary records of the packed sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", good_quality),
    ("near_duplicates", one_of_each),
    ("pii", pseudonymous),
    ("mixing", mixture),
    ("packing", packed),
]

#: SQL can express neither the language model nor the recursive join; tests hold each stage against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
