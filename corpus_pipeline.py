"""The corpus pipeline: each stage works on what the stage before it kept.

Every function takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents.  Extra columns pass through the first four
stages, nulls and empty texts are kept unless a stage's decision concerns them,
and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwater.llm import bpe, mixing, quality, simhash, suffixes
from tarnwater.llm.common import durable, read_table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that the ranking, learnt from all labelled rows, scores under 0.5."""
    ranker = quality.train(docs.select("doc_id", "text"), read_table(spark, sf_dir, "labels"), F.lit(True))
    packed = docs.select(F.struct("*").alias("row"), "text")
    return quality.scores(packed, ranker, ["row"]).where("predicted = 1").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest doc_id; texts link at 0.8 of their five-word shingles."""
    return simhash.keep_one(docs, 5, 0.8)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 240 bytes that occur elsewhere are removed from the texts, so passages of over 50 words go; n_chars follows."""
    return suffixes.deduplicate(docs, suffixes.PASSAGE).withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each draw of a document by the sources' tempered weights."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids and the decoded text's hash of each draw."""
    return bpe.token_rows(docs.select("doc_id", "source", "text"), ["doc_id", "source"])


STAGES = [
    ("quality classifier", quality_filter),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_strings),
    ("mixing sources to target weights", mixture),
    ("BPE encoding and decoding", tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage gives is written before the next one reads it."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = durable(docs, "pipeline")
    return docs
