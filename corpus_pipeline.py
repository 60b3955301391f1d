"""From raw documents to packed sequences: five corpus operators, each stage written as Parquet and read by the next.

A stage takes (spark, docs, sf_dir) and returns documents with all their columns; the last returns the packed pieces. Every
stage keeps each row's columns as they are, those of clashing names included, but for what its docstring says.

Null or empty texts are scored like any other (an empty line), linked with nothing, hold no secrets and have no words, so
that mixing never takes them. Null ids are no documents' names: such rows are judged each by itself and all kept by the
second stage. Of rows that repeat an id the second stage keeps one. Null sources are a source of their own, last in order.
Ties are taken: a score of just the threshold is kept, and of equal texts the smallest id. Very long texts are whole in
every stage. Without labels of both kinds the first stage has one score for all documents. Empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from blockquery.llm import best_fit_packing, line_crf, minhash_dedup, secret_scan, source_mixing
from blockquery.llm.common import Scratch, documents, labels


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field does not reject (score of the threshold or more)."""
    return line_crf.keep_good(docs, labels(spark, sf_dir))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest id."""
    return minhash_dedup.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with secrets masked, and n_chars counted again where one was."""
    return secret_scan.redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: not at all, once or twice."""
    return source_mixing.take_copies(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids and their place in sequences; each copy of a document is packed by itself."""
    return best_fit_packing.pack_documents(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixing", mixing), ("packing", packing)]

#: The trained classifiers, sketches and the tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs, before = Scratch(spark, "pipeline"), documents(spark, sf_dir), ""
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"{i}-{name}")
        if before:
            scratch.drop(before)
        before = f"{i}-{name}"
    return docs
