"""A corpus pipeline: quality rules, near-dedup, secret redaction, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of docs.  Between stages rows live in Parquet, so a lost executor costs one stage.

Defined cases: null and empty texts fail the first stage's base rule and go; where stages run
alone they keep such rows as their operators say.  Columns beside doc_id, text, lang, source
and n_chars pass through the first four stages, whatever their names; an empty table gives an
empty result at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nestquery.llm import mixing_tree, quality_mcd, secret_markov, sentencepiece_bpe, simhash_gph
from nestquery.llm.common import durable_table, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go: null, empty and short ones, those that repeat themselves, and the
    outliers of their group.  Rows that repeat are judged alike, each."""
    return quality_mcd.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest doc_id (null
    last): five-word shingles, Jaccard >= 0.8.  Null and empty texts are one group; of rows
    that repeat id and text one stays; rows that share an id alone are different documents."""
    return simhash_gph.keep_one(docs, shingle=5, similarity=0.8)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of secrets are replaced by a mark, and n_chars follows; null texts stay null."""
    found = secret_markov.scan(docs)
    clean = found.withColumn("text", secret_markov.redact(F.col("text"), F.col("spans")))
    clean = clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*[F.col(f"`{c}`") for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them, in shard order; those without words have no
    share, null sources are a source, rows with equal doc_id and source come together."""
    return mixing_tree.mix(docs).select(*[F.col(f"`{c}`") for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, ids, exact): exact if decoding gives the text back; a null text
    counts as empty and has the end id alone."""
    coded = sentencepiece_bpe.encode_decode(docs.select("doc_id", "source", "text"))
    exact = F.col("decoded") == F.coalesce("text", F.lit(""))
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", exact.alias("exact"))


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_dedup),
    ("secret_scans", secrets),
    ("mixing_sources", mixing),
    ("sentencepiece", tokens),
]

#: The quality and tokenizer stages are iterative; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = durable_table(stage(spark, docs, sf_dir), name)
    return docs
