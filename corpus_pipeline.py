"""The corpus pipeline: quality classifier, exact dedup, near-dedup, mixing, tokens.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor
kept and is written as Parquet before the next reads it. All but the last
return the columns of documents. Mixing repeats rows: from there on a doc_id
may stand several times.

Rows with null or empty text pass the first stage, are one group of copies in the
second (null and empty are equal), are never near-copies and count no words in the
mix. Rows without doc_id, or that repeat one, are judged by their texts alone.
Wholly equal rows are copies. An empty table gives an empty table, and columns
that documents has besides, whatever their names, pass all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from basaltine.llm import exact, minhash, mixing, pieces, quality
from basaltine.llm.scratch import Scratch, documents


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    return quality.quality_filter(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the smallest doc_id."""
    return exact.exact_dedup(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at similarity 0.8 or more."""
    return minhash.near_dedup(docs, shingle=5, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, piece_ids and round_trip."""
    return pieces.encode(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", without_copies),
    ("MinHash near-dedup", without_near_copies),
    ("mixing sources", mixed),
    ("SentencePiece", tokens),
]

#: The trained model and merges by rank have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, from the documents table."""
    scratch = Scratch(spark)
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.write(docs, f"stage-{k}")
            scratch.drop(f"stage-{k - 1}")
    return docs
