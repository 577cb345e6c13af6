"""The corpus pipeline: five operators in a row over documents, each stage written and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import bpe, contamination, cotrain, nearset, substring
from quern.llm.common import stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Low-quality and toxic documents go.

    Null or empty text: scored by the metadata alone. A null doc_id has no label. Rows of one id are judged each by their own
    text; equal rows alike. Without labels, or without documents, nothing is rejected. No length limit.
    """
    return cotrain.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that five-word similarity of 4/5 links, the one with the smallest id stays. Rows without an id stay.

    Null or empty texts all count as one text, of no words. The rows of one id are one document: all stay or go, and equal
    rows all stay. Whole texts are compared. An empty table stays empty.
    """
    copies = nearset.near_copies(docs).filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds go; a changed text is its kept words joined by one space.

    No row goes. Null or empty text, or one of under 13 words: unchanged. A null doc_id counts as the largest; rows of one
    id, equal or not, are not earlier than each other. Any length, and an empty table, will do.
    """
    carry = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    out = substring.dedup_substrings(docs, carry)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go.

    Null or empty text holds none. Each row is judged by its own text, so equal rows go or stay together, ids play no part.
    Items without id or words are not searched for. Whole texts are searched; an empty table stays empty.
    """
    return contamination.clean(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with the digest of the round trip: doc_id and the results, no other column.

    Null or empty text: no tokens. A row for each row, null ids and equal rows included. Texts of any length; an empty table
    gives no rows.
    """
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", quality),
    ("near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE", encoding),
]

ORACLE_SQL = None  # the classifier and connected components have no SQL form; tests/llm compares stages with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
