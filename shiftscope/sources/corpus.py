"""Markdown documents with front matter, and the chunk store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shiftscope.operators.retrieval import index_columns
from shiftscope.operators.text import chunk_text
from shiftscope.session import discard, scratch_path

# fixed values: the header block of a document
FRONT_MATTER = r"(?s)\A---\s*\n(.*?)\n---\s*\n"
RANGE_CHARS = 8 << 20  # characters of a range of documents
CHUNK_COLUMNS = ("dataset", "doc_id", "chunk_no", "title", "doc_type", "doc_date", "text")


def _field(header: Column, name: str) -> Column:
    value = F.regexp_extract(header, rf"(?m)^{name}:[ \t]*(.*?)[ \t]*$", 1)
    plain = F.regexp_replace(value, r"""^(["'])(.*)\1$""", "$2")
    return F.when(plain != "", plain)


def parse_documents(raw: DataFrame) -> DataFrame:
    """(doc_id, title, doc_type, doc_date, text) from (path, raw). The file stem stands in for a missing title."""
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    header = F.regexp_extract("raw", FRONT_MATTER, 1)
    body = F.regexp_replace(F.regexp_replace("raw", FRONT_MATTER, ""), r"^\s+|\s+$", "")
    return raw.select(
        stem.alias("doc_id"), F.coalesce(_field(header, "title"), F.replace(stem, F.lit("_"), F.lit(" "))).alias("title"),
        F.coalesce(_field(header, "type"), F.lit("document")).alias("doc_type"), _field(header, "date").try_cast("date").alias("doc_date"),
        body.alias("text"),
    )


def read_corpus(spark: SparkSession, folder: str, glob: str = "*.md") -> DataFrame:
    """All documents of a folder, one whole file per row."""
    files = spark.read.option("pathGlobFilter", glob).text(folder, wholetext=True)
    return parse_documents(files.select(F.input_file_name().alias("path"), F.col("value").alias("raw")))


def make_chunks(documents: DataFrame, dataset: str) -> DataFrame:
    """Chunk rows of a dataset, with the columns a search needs."""
    rows = chunk_text(documents, "text").withColumn("dataset", F.lit(dataset))
    return index_columns(rows.select(*CHUNK_COLUMNS))


def ingest_chunks(chunks: DataFrame, store: str) -> None:
    """Replace the chunks of the datasets in ``chunks``; other datasets in the store stay untouched."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset").parquet(store)


def open_chunks(spark: SparkSession, store: str, dataset: str | None = None) -> DataFrame:
    """Chunks of the store; a dataset reads only its own folder."""
    rows = spark.read.parquet(store)
    return rows.where(F.col("dataset") == dataset) if dataset else rows


def by_document(documents: DataFrame) -> DataFrame:
    """Documents dealt by ranges of ``doc_id``, at least one range a core: chunks made of these need no other move to be in order."""
    cores = documents.sparkSession.sparkContext.defaultParallelism
    chars = documents.agg(F.sum(F.length("text"))).first()[0] or 0
    return documents.repartitionByRange(max(cores, -(-chars // RANGE_CHARS)), "doc_id")


def export_chunks(chunks: DataFrame, path: str, placed: bool = False) -> None:
    """All chunks ordered by dataset, document and number; range-partitioned, so the order spans the files.

    ``placed`` chunks are those of one dataset, made of documents ``by_document``: they are put in order where they are. Others are written once before
    that, as bounds of the ranges come from a pass of their own.
    """
    order = ["dataset", "doc_id", "chunk_no"]
    if placed:
        chunks.sortWithinPartitions(*order).write.mode("overwrite").option("compression", "zstd").parquet(path)
        return
    made = scratch_path(chunks.sparkSession, "chunks")
    chunks.write.option("compression", "zstd").parquet(made)
    chunks.sparkSession.read.schema(chunks.schema).parquet(made).orderBy(*order).write.mode("overwrite").option("compression", "zstd").parquet(path)
    discard(chunks.sparkSession, made)
