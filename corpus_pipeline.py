"""From raw documents to token ids: reject, dedup lines, dedup documents, mix, encode.

Each stage takes what its predecessor kept, whole. run() keeps every stage's
result in the shared checkpoint folder, so that a lost executor costs one
stage's partitions and nothing is computed twice.

Defined results: an empty table gives no rows; a null text counts as empty
where it is scored, deduplicated and mixed, and so is never in the mix; rows
with a null id are documents of their own, of which equal texts are near
duplicates; repeated rows are near duplicates of each other; of near duplicates
the smallest id stays, of equal ids one row; extra columns are carried to the
end, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import line_dedup, mixing, near_dup, quality, sentence_piece
from tessera.llm.common import cut, table
from tessera.llm.queries import sentencepiece_model


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the neighbour vote scores below the threshold go."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of any length that repeat an earlier one, and from 5 words on those a word apart, go; a document that loses all stays, empty."""
    rows = line_dedup.dedup(docs)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest id."""
    return near_dup.representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is served, at most twice."""
    rows = mixing.mix(docs)
    return rows.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else rows


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text of the mix."""
    return sentence_piece.encode(docs, sentencepiece_model(), carry=[c for c in docs.columns if c != "text"])


STAGES = [
    ("quality", reject_low_quality),
    ("line_dedup", dedup_lines),
    ("near_dup", dedup_documents),
    ("mix", mix_sources),
    ("sentencepiece", encode_texts),
]

#: Neighbour voting and the tokenizer are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
