"""The corpus pipeline: quality, near-duplicates, personal data, mixing, encoding. Each stage takes all documents that the
one before kept and, but for the last, returns them with the columns of documents, further columns included. An empty table
stays empty; repeated rows are rows of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from typeloom.llm.bpe import encode_documents
from typeloom.llm.common import discard, fold, table, written
from typeloom.llm.mixing import mixture
from typeloom.llm.neardup import near_duplicates
from typeloom.llm.pii import replaced
from typeloom.llm.quality import score, train


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier gives 0.5 or more; it learns from the labelled documents, as its query does.
    Empty texts have a score too; without labels every document scores 0.5 or the share of label 1."""
    machine = train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold("doc_id", 3) != 1)
    return score(docs, machine, keep=0.5)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words, a similarity of 0.8. Documents without words or without
    doc_id stand alone and stay; of a kept id all rows stay."""
    kept = near_duplicates(docs, words=5, percent=80).where("kept").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")), "left_semi")


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by surrogates; null and empty texts stay."""
    return replaced(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, as often as it takes them."""
    return mixture(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each document: its id (null stays null), the number and digest of its tokens, the digest of the decoded text."""
    return encode_documents(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("pii", pii), ("mixing", mixing), ("encoding", encoding)]

#: Learned models, sketches and ciphers: not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written to the shared folder and read again; a stage's table is deleted when
    the next one is written."""
    docs, last = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(spark, docs, f"pipeline-{name}")
            if last is not None:
                discard(spark, last)
            last = docs
    return docs
