"""The corpus pipeline: each stage calls one operator and hands its documents to the next.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. Stages identify rows by their file and place in it, so rows with null or equal ids are
kept apart, and whole rows join the verdicts by that number alone.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.llm import common, exact_dedup, mixing, packing, simhash, toxicity

#: The pipeline's learning rows are those of op6.
FOLDS, HELD_OUT = 5, 0


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a row number, and the number's column, which is none of those of docs."""
    row = common.free_name(docs, "_row")
    return common.with_row(docs, row), row


def _joined(docs: DataFrame, kept: DataFrame, row: str) -> DataFrame:
    return docs.join(kept.select(row), row, "left_semi").drop(row)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5.

    Null and empty texts have no votes for toxic and stay; equal rows have one score, so all of them stay or go. Labels
    of no document count for nothing. Very long texts are read whole. An empty table stays empty.
    """
    docs, row = _numbered(docs)
    labels = common.table(spark, sf_dir, "labels").where(common.fold("doc_id", FOLDS) != HELD_OUT)
    return _joined(docs, toxicity.toxicity(docs, labels, row_col=row).where("predicted = 0"), row)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id.

    Null texts count as empty ones, of which one stays. A null id is smaller than any other, and of rows with equal ids
    the first stays. Very long texts are compared whole. An empty table stays empty.
    """
    docs, row = _numbered(docs)
    return _joined(docs, exact_dedup.exact_duplicates(docs, row_col=row).where("kept"), row)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the least id.

    Texts without a word, null ones too, are one class with any near fingerprint zero. A null id comes after any other,
    and of rows with equal ids the first stays. Very long texts have one fingerprint, of all their words. An empty table stays empty.
    """
    docs, row = _numbered(docs)
    return _joined(docs, simhash.near_duplicates(docs, row_col=row).where("kept"), row)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as often as the mix takes them, dealt to its shards and shuffled there.

    A null source is a source. Documents without words, null texts too, are in no source's words and go. Equal rows are
    taken each by itself; which of them makes no difference. A very long text is taken whole or not at all. An empty table
    stays empty.
    """
    docs, row = _numbered(docs)
    copies, _ = mixing.draw(mixing.sized(docs, "doc_id", "text", "source", row), whole=True)
    shard, place = common.free_name(docs, "_shard"), common.free_name(docs, "_place")
    mixed = docs.join(copies.select(F.col("row").alias(row), F.col("shard").alias(shard), F.col("place").alias(place)), row)
    return mixed.repartition(common.tasks(spark), shard).sortWithinPartitions(shard, place).drop(row, shard, place)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens.

    Null texts count as empty and are the end token alone; equal rows are packed each by itself. Very long texts are cut into
    pieces, none of which is lost. An empty table gives no pieces.
    """
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL cannot express the stages; tests compare them with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.written(docs, name)
    return docs
