"""The corpus pipeline: quality rules, exact and near duplicates, mixing, and tokens.

Each stage works on all that the one before kept. All but the last return the columns of documents; the last
adds the token ids of each document's text, their number, and whether they decode to the text again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import exact, jaccard, mixing, quality, spm
from tessera.llm.common import cut, discard

#: SQL has no SentencePiece encoding; tests hold the stages against brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep."""
    return quality.quality_filter(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal but for A-Z's case, the one of the largest id."""
    return exact.exact_dedup(docs)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that near duplicates link, the one of the smallest id."""
    return jaccard.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as its source's target asks for; none, up to three times."""
    return mixing.mix(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the token ids of their texts, their number, and whether they decode to the text again."""
    return spm.encode(docs, check=True)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", ngram_join),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each on what the one before wrote; a table goes once the next stage's is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        held, docs = docs, cut(stage(spark, docs, sf_dir), "pipeline")
        discard(held)
    return STAGES[-1][1](spark, docs, sf_dir)
