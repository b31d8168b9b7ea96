"""From documents to packed training sequences: quality rules, near-duplicates, repeated passages, personal data, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from shiftscope.llm.common import begin, saved, table
from shiftscope.llm.packing import pack_documents
from shiftscope.llm.pii import pseudonymised
from shiftscope.llm.quality import kept_documents
from shiftscope.llm.simhash import one_of_each
from shiftscope.llm.substrings import remove_repeats

#: A corpus takes a secret key.
KEY = "public test key"
#: Pieces of text a task of packing remembers. Its workers stay for the stages of the next run, with what they hold.
REMEMBERED = 90_000


def _as(docs: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` with the columns of ``docs``; a count of characters follows the text."""
    counted = new.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else new
    return counted.select([F.col(f"`{c}`") for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the rules reject go."""
    begin(spark)
    return kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    begin(spark)
    return one_of_each(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that an earlier document holds go, and documents of which nothing is left."""
    begin(spark)
    cut = remove_repeats(docs).where("n_removed = 0 or n_removed < n_words")
    return _as(docs, cut.select("doc_id", "text", "rest.*") if len(docs.columns) > 2 else cut)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become pseudonyms."""
    begin(spark)
    return _as(docs, pseudonymised(docs, KEY, counts_col=None))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens."""
    begin(spark)
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, max_tokens=1024, remember=REMEMBERED)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeats", repeats), ("personal_data", personal_data), ("packing", packing)]

#: Expectation-maximisation and byte-pair encoding are beyond SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage; every stage before it is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
