"""Corpus pipeline: quality filter, line dedup, near dedup, packing. Each stage works on what the one before it kept.

Every stage takes the columns of `documents` and leaves others aside. A null text counts as an empty one, an empty table stays
empty, and nulls in lang, source and n_chars are carried. Ties and repeated rows are settled by the stage, see there.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earlog.llm import line_dedup, minhash_dedup, packing, quality_cnn
from earlog.llm.common import read
from earlog.llm.queries import tokenizer
from earlog.session import ensure_checkpoint_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: SQL cannot express a trained network, prefix doubling or a tokenizer.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte network takes for label 1; it learns from the labelled ones among them.

    Texts are scored one by one: repeated rows share their fate, empty and null texts get the score of no text.
    """
    labels = read(spark, sf_dir, "labels", "doc_id", "quality")
    docs = docs.select(*COLUMNS)
    net = quality_cnn.train(docs, labels)
    return quality_cnn.score(docs, net, out="_score").where("_score >= 0.5").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go; a document that loses all its lines goes as well.

    Documents stand by doc_id, null last, then by the hash of the text; rows equal in both are one document. Empty and null texts
    have no run and stay.
    """
    out = line_dedup.line_dedup(docs.select(*COLUMNS))
    return out.where((F.col("deleted_lines") == 0) | (F.length("text") > 0)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one of smallest id; five words, similarity 0.8.

    All rows of a doc_id go or stay together; rows without an id, without words or without text stay.
    """
    docs = docs.select(*COLUMNS)
    gone = minhash_dedup.minhash_components(docs).where(~F.col("kept")).select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("gone"), "left_anti").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents with their place in sequences of 2048 tokens.

    A document without text is its end token; repeated rows and rows without an id are packed like others, ties in length fall in
    hash order.
    """
    pieces = packing.token_pieces(docs, tokenizer("word_bpe_49k.json"), with_ids=False)
    return packing.pack(pieces).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
