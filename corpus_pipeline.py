"""The corpus pipeline: quality filter, near-duplicate removal, secret redaction, source mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sigmill.llm.common import documents, materialize
from sigmill.llm.mixing import repeat_copies
from sigmill.llm.neardup import keep_one
from sigmill.llm.packing import pack
from sigmill.llm.quality import fit, keep_good
from sigmill.llm.secrets import redact


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the classifier, fitted on the labels of this corpus, accepts.

    Null and empty texts are scored as no text; without labels every score is 0.5 and all rows stay; repeated rows, null
    ids and columns of any other name pass through.
    """
    return keep_good(docs, fit(docs, documents(spark, sf_dir, "labels")))


def neardup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies: the one with the smallest id. Copies are told by runs of
    five words; the two-word runs are those of ``op2_neardup`` alone. Texts without words and rows with a null id
    stay; rows that share an id are one document."""
    return keep_one(docs, words=5)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every found secret by a mark; no document goes. Null texts stay null, and each row loses the secrets of its
    own text, whatever ids it shares."""
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop documents so that the sources' words follow their weights. A null source is one of its own, weighed
    last; rows without words are kept once; equal rows fare alike."""
    return repeat_copies(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences: each row as often as the mix has it, null and empty texts as their end token, an
    empty table as no rows."""
    return pack(docs)


STAGES = [
    ("quality", quality),
    ("neardup", neardup),
    ("secrets", secrets),
    ("mixing", mixing),
    ("packing", packing),
]

#: The classifier, the tokenizer and the packing can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
