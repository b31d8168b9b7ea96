"""Token files with fixed-width bit packing.

A file set is a folder with ``blocks`` (Parquet) and ``manifest`` (Parquet). A row of ``blocks`` holds whole documents, at least
``block_ids`` ids unless it is the last of its part: their ids in ``width`` bits each, the place of every document in the block,
and the block's first id within its part. ``manifest`` has the first id and the number of ids of every part, so the place of any id
in the corpus is known without reading a payload. Parts and blocks follow ascending doc_id (null first; equal ids by hash of the text,
then by the text itself). Parquet carries the bytes, so any store that Spark reads and writes will do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from shiftscope.llm.chunkcache import TEXTS, encoder
from shiftscope.llm.common import groups_of, slices

BLOCKS = "part int, block int, first long, n_ids long, width int, doc_ids array<long>, doc_starts array<long>, payload binary"

#: Parts of a file set, at most; the manifest has a row for each. Parts of larger sets are longer, and are written as they come.
PARTS = 1 << 16


def bits_for(size: int) -> int:
    """The least width that holds every id below ``size``."""
    return max(1, (size - 1).bit_length())


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    """ids below 2**width, least significant bit first, one after the other without gaps."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids.astype(np.uint64)[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_bits(payload: bytes, width: int, first: int, count: int) -> np.ndarray:
    """``count`` ids from position ``first`` on, touching their bytes only."""
    if count == 0:
        return np.empty(0, np.uint32)
    at = first * width
    low = at // 8
    if width in (8, 16, 32):
        return np.frombuffer(payload, f"<u{width // 8}", count, low).astype(np.uint32)
    raw = np.frombuffer(payload[low : (at + count * width + 7) // 8] + b"\0" * 5, np.uint8).astype(np.uint64)
    bit = np.arange(count, dtype=np.int64) * width + at % 8
    byte = bit // 8
    value = sum(raw[byte + k] << np.uint64(8 * k) for k in range(5))
    return ((value >> (bit % 8).astype(np.uint64)) & np.uint64((1 << width) - 1)).astype(np.uint32)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int | None, block_ids: int = 1 << 16, part_bytes: int = 8 << 20, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode ``docs`` in ascending id order and write a file set below ``path``. Null texts are empty documents."""
    spark = docs.sparkSession
    parts = min(PARTS, groups_of(docs, text_col, part_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        width, size = bits_for(encode.size), encode.dtype.itemsize
        end = b"" if end_id is None else np.array([end_id], encode.dtype).tobytes()
        part, block, first = TaskContext.get().partitionId(), 0, 0
        held, names, starts, n = [], [], [], 0

        def full():
            payload = pack_bits(np.frombuffer(b"".join(held), encode.dtype), width)
            values = ([part], [block], [first], [n], [width], [names], [starts], [payload])
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()))], [c.split()[0] for c in BLOCKS.split(", ")])

        for batch in slices(batches, TEXTS):
            for doc, raw in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist())):
                names.append(doc)
                starts.append(n)
                held.append(raw + end)
                n += len(held[-1]) // size
                if n >= block_ids:
                    yield full()
                    block, first, held, names, starts, n = block + 1, first + n, [], [], [], 0
        if names:
            yield full()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    blocks = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order, "text").mapInArrow(run, BLOCKS)
    blocks.write.mode("overwrite").parquet(f"{path}/blocks")
    # one row for each part; parts are counted by the writer above, not by the data's keys
    sums = spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n_ids").alias("n_ids")).orderBy("part").collect()
    manifest, before = [], 0
    for part, n in sums:
        manifest.append((part, before, n))
        before += n
    spark.createDataFrame(manifest, "part int, first long, n_ids long").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    manifest = spark.read.parquet(f"{path}/manifest").select("part", F.col("first").alias("part_first"))
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    return blocks.join(F.broadcast(manifest), "part").select("doc_ids", "doc_starts", "payload", "width", "n_ids", (F.col("part_first") + F.col("first")).alias("first"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit), read from a file set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):  # a block at a time
            for row in batch.to_pylist():
                ids = unpack_bits(row["payload"], row["width"], 0, row["n_ids"]).astype("<u4")
                edges = [*row["doc_starts"], row["n_ids"]]
                out = [ids[a:b].tobytes() for a, b in zip(edges, edges[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array([row["first"] + a for a in edges[:-1]], pa.int64()), pa.array([len(x) // 4 for x in out], pa.int64()), pa.array(out, pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids"])

    return _blocks(spark, path).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def read_ids(spark: SparkSession, path: str, start: int, count: int) -> DataFrame:
    """position and id for ``count`` ids from corpus position ``start`` on; only blocks that hold some of them are unpacked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):  # a block at a time
            for row in batch.to_pylist():
                low, high = max(start, row["first"]), min(start + count, row["first"] + row["n_ids"])
                ids = unpack_bits(row["payload"], row["width"], low - row["first"], high - low)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(low, high)), pa.array(ids.astype(np.int64))], ["position", "id"])

    held = _blocks(spark, path).where((F.col("first") < start + count) & (F.col("first") + F.col("n_ids") > start))
    return held.mapInArrow(run, "position long, id long")
